"""Shared helpers: written intermediate tables, file access from tasks, null-safe ids.

Intermediate tables go to the folder that the session names in ``spark.checkpoint.dir`` (shared by driver and
executors), so a lost executor costs no more than a re-read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from ..sources.paths import filesystem

#: Order of the null id: before every other id.
NULL_ID = -(1 << 63)
#: The six ASCII white-space characters of the contracts, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: computed once, lineage cut."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def forget(df: DataFrame) -> None:
    """Deletes the files of a table from :func:`written` that nothing reads any more (rounds of an iteration)."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.written_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_of(name: str = "doc_id") -> Column:
    """The id as a long that joins and orders; the null id comes before all others."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_back(col: Column) -> Column:
    return F.when(col != F.lit(NULL_ID), col)


def lower_ascii(col: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(col, UPPER, LOWER)


def once(udf):
    """``udf`` marked so that the optimizer never copies it into filters it infers (that would run it twice)."""
    return udf.asNondeterministic()


def open_filesystem(uri: str):
    """(filesystem, path) of a Hadoop-style uri (s3a and wasb(s) by Arrow's names), for byte access inside tasks."""
    return filesystem(uri)
