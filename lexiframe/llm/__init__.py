"""Operators of a training-data pipeline: quality, PII, decontamination, WARC, token counts, mixing, line and
near-duplicate removal, token output, fingerprints.  Nothing else in the library imports this subpackage."""
