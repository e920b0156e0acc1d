"""The corpus pipeline: quality, near-duplicates, decontamination, mixing, token output.

Each stage takes what its predecessor kept, as documents, and the table folder for its side inputs; its result is
written as Parquet in the shared folder and read back, so that a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiframe.llm import decontam, mixing, quality, simhash, token_output
from lexiframe.llm.common import written
from lexiframe.llm.queries import OUTPUT_VOCABULARY, vocabulary_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose rating is probably the best one (good and clean).

    Null texts count as empty ones; rows that repeat are judged alike; without rated rows all stay."""
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash class: the one with the least id, a null id before all others; of rows that repeat
    it one stays.  Texts without words are one class."""
    return simhash.keep_one(docs, shingle=3, distance=2)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null and empty texts have none, and such items match nothing."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample with the target mixture of sources, languages and topics; null or unnamed values are one category, rows
    that share an id are sampled together."""
    return mixing.sample_mixture(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files; per document what they hold (doc_id, start, n_tokens, ids_crc32): null texts are empty, rows with
    equal ids follow each other."""
    return token_output.token_output(docs, vocabulary_path(OUTPUT_VOCABULARY), end_id=1)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage),
          ("decontamination", decontamination_stage), ("mixing", mixing_stage), ("tokens", token_stage)]

#: A fitted model, XXH64 shingles and a tokenizer are beyond SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; an empty table gives no rows."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
