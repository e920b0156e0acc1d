"""Row numbers in file order, over any number of files, without sorting rows.

A file's rows are in order already: what a number needs besides is how many rows come before the piece of the file that
a task reads.  Pieces are counted, their counts summed in order (one row per piece), and joined back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranking import join_small
from ..session import reliable_checkpoint


def _before(pieces: DataFrame, file: str, *inside: str) -> DataFrame:
    """``pieces`` (with n rows each) and ``__before``, the rows of all earlier files and pieces; and of those of its file,
    ``__in_file``.  Files follow each other by path; the windows run over one row per piece and per file."""
    totals = pieces.groupBy(file).agg(F.sum("n").alias("__total"))
    files = totals.select(file, F.coalesce(F.sum("__total").over(
        Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__files"))
    if not inside:
        return files.withColumnRenamed("__files", "__before").withColumn("__in_file", F.lit(0).cast("long"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy(file).orderBy(*inside).rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0))
    each = join_small(pieces.withColumn("__in_file", own), files, [file])
    return each.withColumn("__before", F.col("__files") + F.col("__in_file")).drop("__files")


def numbered_scan(scan: DataFrame, out: str = "row_id", line: str | None = None, file: str | None = None) -> DataFrame:
    """``scan`` (text, CSV or JSON files as read, before any filter) with ``out``: 0, 1, 2, ... in the order of the
    files, by path, as if they were read in turn; ``line``, if given, numbers the rows of each file, ``file`` names it.

    A task numbers its rows as it reads them; the checkpoint fixes these numbers.  A split of a file is read whole by one
    task, so a row's place in its split is its number less the split's first."""
    rows = scan.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    rows = reliable_checkpoint(rows.withColumn("__id", F.monotonically_increasing_id()))
    pieces = rows.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("__first"))
    joined = join_small(rows, _before(pieces, "__file", "__block").drop("n"), ["__file", "__block"])
    at = F.col("__id") - F.col("__first")
    extra = ([(F.col("__in_file") + at).alias(line)] if line else []) + ([F.col("__file").alias(file)] if file else [])
    return joined.select(*[F.col(f"`{c}`") for c in scan.columns], *extra, (F.col("__before") + at).alias(out))


def read_numbered_parquet(spark: SparkSession, path: str | Sequence[str], out: str = "row_id") -> DataFrame:
    """Parquet files with ``out``: 0, 1, 2, ... in file order.  The format knows each row's index in its file, so only
    the files are counted (from their footers), nothing is stored and the scan stays lazy."""
    scan = spark.read.parquet(*([path] if isinstance(path, str) else path))
    names = [F.col(f"`{c}`") for c in scan.columns]
    counts = scan.select(F.col("_metadata.file_path").alias("__file")).groupBy("__file").agg(F.count(F.lit(1)).alias("n"))
    rows = scan.select(*names, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    return join_small(rows, _before(counts, "__file"), ["__file"]).select(
        *names, (F.col("__before") + F.col("__index")).alias(out))
