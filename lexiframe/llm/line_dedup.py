"""Line de-duplication with keep bitmaps (DataFrame functions only).

Every line key is hashed to 128 bits; lines are range-partitioned by (hash, lot), where the lot is a hash of the document
that splits a line found everywhere over many tasks, and sorted by document, last first, and position.  One streaming
pass over each sorted run marks the first occurrence of the key and of each document in it, with the positions of
the lines.  First occurrences of lots are compared by key; what comes back is no text: per document the runs of lines
that stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_SPACE, id_back, id_of, lower_ascii, text_of, written


def _lines(text):
    return F.split(text, "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, th, pos, h1, h2: one row per line whose key has at least ``min_chars`` code points.

    The key is the line without ASCII white space at both ends, A-Z lower-cased; ``th`` tells apart rows that share
    a document id."""
    lines = docs.select(id_of(id_col).alias("did"), F.xxhash64(text_of(text_col)).alias("th"),
                        F.posexplode(_lines(text_of(text_col))).alias("pos", "line"))
    bare = F.btrim(F.col("line"), F.lit(ASCII_SPACE))
    long_lines = lines.where(F.length(bare) >= min_chars)
    key = lower_ascii(bare)
    return long_lines.select("did", "th", "pos", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def first_occurrences(keys: DataFrame, lots: int | None = None) -> DataFrame:
    """``keys`` (h1, h2, did, pos, ...) with two marks of their place in the order of document, last first, and position:
    first_of_lot, the first row of a key and lot, and first_of_doc, a document's first row with the key.

    The window needs what the range partitioning and its sort give (no further exchange): a task streams through
    its ranges and holds one row back."""
    lots = lots or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.withColumn("lot", F.pmod(F.xxhash64("did"), F.lit(lots)).cast("int")) \
        .repartitionByRange("h1", "h2", "lot").sortWithinPartitions("h1", "h2", "lot", F.col("did").desc(), "pos")
    stream = Window.partitionBy("h1", "h2", "lot").orderBy(F.col("did").desc(), "pos")
    before = F.lag("did").over(stream)
    return ranged.withColumn("first_of_lot", before.isNull()) \
        .withColumn("first_of_doc", before.isNull() | (before != F.col("did"))).drop("lot")


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """did, th, n_dropped, keep: the run-length keep bitmap of every document that loses a line.

    A key found in at least ``min_docs`` documents keeps its lines in the largest document id only.  ``keep`` is an
    array of (start, length) runs of lines that stay, in order; a document without a row keeps every line.  Rows with
    a null id count as one document that comes before all others; a null text is one empty line; equal rows get the
    same bitmap (one row).  Hash of the key: 128 bits."""
    marked = written(first_occurrences(written(line_hashes(docs, min_chars, id_col, text_col), "line-hashes")), "line-marks")
    # a lot tells how many documents it holds and the first one, which is the last by id
    firsts = marked.where("first_of_doc").groupBy("h1", "h2").agg(
        F.count(F.lit(1)).alias("n_docs"), F.max(F.when(F.col("first_of_lot"), F.col("did"))).alias("last_did"))
    # a table of its own, so that the join below can split the lines of a key that is everywhere
    repeated = written(firsts.where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_did"), "repeated-lines")
    drops = marked.join(repeated, ["h1", "h2"]).where(F.col("did") < F.col("last_did"))
    per_doc = drops.groupBy("did", "th").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    m = F.size("dropped")
    # run i lies between the dropped lines i - 1 and i; the last one is open-ended (length -1)
    runs = F.transform(F.sequence(F.lit(0), m), lambda i: F.struct(
        F.when(i == 0, F.lit(0)).otherwise(F.element_at("dropped", F.greatest(i, F.lit(1))) + 1).alias("start"),
        F.when(i == m, F.lit(-1)).otherwise(
            F.element_at("dropped", F.least(i + 1, m))
            - F.when(i == 0, F.lit(0)).otherwise(F.element_at("dropped", F.greatest(i, F.lit(1))) + 1)).alias("length")))
    return per_doc.select("did", "th", m.cast("long").alias("n_dropped"),
                          F.filter(runs, lambda r: r["length"] != 0).alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, n_lines, n_dropped, kept_text: the lines of each row of ``docs`` that its bitmap keeps, joined by \\n."""
    base = docs.select(id_of(id_col).alias("did"), text_of(text_col).alias("text")) \
        .withColumn("th", F.xxhash64("text"))
    both = base.join(bitmaps, ["did", "th"], "left")
    lines = _lines(F.col("text"))
    kept = F.flatten(F.transform("keep", lambda r: F.slice(
        lines, r["start"] + 1, F.when(r["length"] >= 0, r["length"]).otherwise(F.greatest(F.size(lines) - r["start"], F.lit(0))))))
    return both.select("did", F.size(lines).cast("long").alias("n_lines"),
                       F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
                       F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
                       .alias("kept_text"))


def line_dedup_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 per row of ``docs``; an empty table gives no rows."""
    out = apply_bitmaps(docs, keep_bitmaps(docs, min_chars, min_docs))
    return out.select(id_back(F.col("did")).alias("doc_id"), "n_lines", "n_dropped",
                      F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key
      HAVING count(DISTINCT doc_id) >= 5),
f AS (SELECT k.doc_id, k.pos, k.line, (g.key IS NOT NULL AND k.doc_id < g.last_doc) AS gone
      FROM k LEFT JOIN g ON k.key = g.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY doc_id
"""
