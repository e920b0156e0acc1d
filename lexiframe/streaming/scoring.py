"""Streaming form of batch scoring (O-M8 over a stream).

The scoring path is stateless (tokenize, features, linear model, softmax,
argmax), so the very same DataFrame functions apply to a streaming source:
text files arriving in a folder -> sentences -> scores -> a file sink, with
the stream's progress kept in a folder that the caller names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import split_lines, strip_ws


def sentence_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Text files under ``path`` as a stream of sentences (one per line, stripped,
    blanks dropped — the same rules as the batch reader).  Output: source, sentence."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    raw = r.load(path).select(F.input_file_name().alias("source"), "value")
    pieces = raw.select("source", F.explode(split_lines("value")).alias("__l"))
    return pieces.select("source", strip_ws("__l").alias("sentence")).where(F.col("sentence") != "")


def score_stream(stream: DataFrame, scorer: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Apply a stateless scorer (e.g. ``lambda d: model.predict(m, d, ...)``)."""
    return scorer(stream)


def write_available_now(df: DataFrame, sink_path: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Process everything available now, then stop.  ``checkpoint`` is a lasting folder of the
    caller's: a restarted stream that names it again goes on where the last one ended."""
    q = (df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()
    return q
