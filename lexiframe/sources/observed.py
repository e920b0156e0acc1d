"""Counts of what is written, taken while it is written."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .files import require_columns


def write_observed(df: DataFrame, write: Callable[[DataFrame], None], required: Iterable[str] = ()) -> DataFrame:
    """Runs ``write(df)`` and returns column, n_rows, n_null for every column of what was written.

    The rows are counted on their way to the writer (no second scan, and no reading back); columns in ``required`` must be
    there.  Observe what is written as it is: after a later shuffle a repeated task would count its rows again."""
    require_columns(df, required)
    seen = Observation("written")
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)]
    write(df.observe(seen, F.count(F.lit(1)).alias("rows"), *nulls))
    counts = seen.get
    rows = [(c, counts["rows"], counts[f"n{i}"]) for i, c in enumerate(df.columns)]
    return df.sparkSession.createDataFrame(rows, "column string, n_rows long, n_null long")
