"""Inputs derived by Spark from the driver tables (see FIXTURES.md §3).

Every derivation is a plain DataFrame plan over a given table, so its work
grows with the table; nothing here is invented data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import letter_count, words
from ..functions.vectors import bind
from ..operators.ranking import sequence_number
from ..session import reliable_checkpoint

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")

# --- Fixed values: class letters of the rule-based scorer (class order de, en, es, fr)
SCORE_LETTERS = (("de", "ü"), ("en", "w"), ("es", "ó"), ("fr", "é"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table as its files split it (``spark.sql.files.maxPartitionBytes``)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


# ----------------------------------------------------------------------------- sentences

def multilabel_sentences(docs: DataFrame, keep=()) -> DataFrame:
    """row_id, sentence, label — label = ``lang,source`` (two labels per row)."""
    return docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"),
                       F.concat_ws(",", F.col("lang"), F.col("source")).alias("label"), *keep)


def single_label_sentences(docs: DataFrame) -> DataFrame:
    """row_id, sentence, label — label = ``lang`` (four classes)."""
    return docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"),
                       F.col("lang").alias("label"))


def conversation_label_items(conv: DataFrame) -> DataFrame:
    """The roles of each conversation as an exploded multi-label list: row_id = conv_id,
    label_item = role.  A conversation of any length is never gathered."""
    return conv.select(F.col("conv_id").alias("row_id"), F.col("role").alias("label_item"))


# ----------------------------------------------------------------------------- tokens / attention

def benchmark_tokens(bench: DataFrame, piece: int = 5) -> DataFrame:
    """Word-piece-like tokens of every whole ``benchmark`` text: lower-case words;
    a word longer than ``piece`` characters becomes its first ``piece`` characters
    and ``##`` + the rest; ``[CLS]`` first and ``[SEP]`` last.
    Output: sample_id, pos, token."""
    ws = words(F.lower(F.col("text")))
    pieces = F.flatten(F.transform(ws, lambda w: F.when(
        F.length(w) > piece, F.array(F.substring(w, 1, piece), F.concat(F.lit("##"), F.substring(w, piece + 1, 1 << 30))))
        .otherwise(F.array(w))))
    toks = F.concat(F.array(F.lit("[CLS]")), pieces, F.array(F.lit("[SEP]")))
    return bench.select(F.col("item_id").alias("sample_id"), F.posexplode(toks).alias("pos", "token")) \
        .select("sample_id", F.col("pos").cast("int").alias("pos"), "token")


# --- Fixed values: the integer attention formulas (raw weight, then row-normalised); code = first code point of a token
EVAL_RUN = (7, 13, 3, 5, 0, 11)      # raw = (7q + 13k + 3 layer + 5 head + code(q) + code(k)) % 11 + 1
DROPOUT_RUN = (5, 11, 2, 3, 1, 13)   # raw = (5q + 11k + 2 layer + 3 head + 1 + code(q) + code(k)) % 13 + 1


#: Attention cells that a partition is dealt.
PARTITION_CELLS = 1 << 18


def synthetic_attention_rows(tokens: DataFrame, layers: int = 3, heads: int = 2, run: str = "eval") -> DataFrame:
    """Dense attention over each sample's tokens, a row per query position: sample_id, layer, head, q, weights (array over
    k, which sums to 1).  Positions and tokens enter the weight, so a token at a wrong position shows.

    A sample's token codes come together once (bounded by the model's sequence length).  The samples are dealt to as
    many partitions as their cells need: by their bytes, which AQE goes by, they would all land in one, where the rows
    are a hundred times larger.
    """
    a, b, c, d, off, m = EVAL_RUN if run == "eval" else DROPOUT_RUN
    s = tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.ascii("token").alias("code")))).alias("__t"))
    codes = reliable_checkpoint(s.select("sample_id", F.transform("__t", lambda x: x["code"]).alias("__codes")))
    size = F.size("__codes").cast("long")
    cells = codes.agg(F.sum(size * size)).first()[0] or 0
    codes = codes.repartition(max(1, -(-cells * layers * heads // PARTITION_CELLS)), "sample_id")
    rows = (codes.select("*", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"))
            .select("*", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
            .select("*", F.posexplode("__codes").alias("q", "__code")))
    base = F.col("q") * a + F.col("layer") * c + F.col("head") * d + off + F.col("__code")
    raw = F.transform("__codes", lambda code, k: ((base + k * b + code) % m + 1).cast("double"))
    total = lambda w: F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
    weights = bind(raw, lambda w: bind(total(w), lambda t: F.transform(w, lambda x: x / t)))
    return rows.select("sample_id", "layer", "head", "q", weights.alias("weights"))


def synthetic_attention(tokens: DataFrame, layers: int = 3, heads: int = 2, run: str = "eval") -> DataFrame:
    """The cells of :func:`synthetic_attention_rows`: sample_id, layer, head, q, k, weight; exploded where the rows are,
    without a shuffle of the cell table."""
    return synthetic_attention_rows(tokens, layers, heads, run) \
        .select("sample_id", "layer", "head", "q", F.posexplode("weights").alias("k", "weight"))


# ----------------------------------------------------------------------------- training log

def events_trainer_log(events: DataFrame) -> DataFrame:
    """The event stream recast as training-log records, one run per user:
    run = user_id; rn = ordinal by (ts, event_id); step = floor((rn + 1) / 2);
    odd rn -> train record (loss = value / 100), even rn -> eval record; runs with an odd
    user_id begin with an eval record, so that some have more of these than train records
    (eval_loss = value / 100, eval_f1 = k / 100, eval_accuracy = (100 - k) / 100).
    Output: run, log_pos, step, epoch, loss, eval_loss, eval_f1, eval_accuracy."""
    ev = events.select(F.col("user_id").alias("run"), "ts", "event_id", "value",
                       F.get_json_object("props", "$.k").cast("double").alias("__k"))
    ev = sequence_number(ev, ["run"], ["ts", "event_id"], out="log_pos")
    step = F.floor((F.col("log_pos") + 1) / 2).cast("long")
    odd = (F.col("log_pos") + F.col("run")) % 2 == 1
    return ev.select("run", "log_pos", step.alias("step"), step.cast("double").alias("epoch"),
                     F.when(odd, F.col("value") / 100).alias("loss"),
                     F.when(~odd, F.col("value") / 100).alias("eval_loss"),
                     F.when(~odd, F.col("__k") / 100).alias("eval_f1"),
                     F.when(~odd, (100 - F.col("__k")) / 100).alias("eval_accuracy"))


# ----------------------------------------------------------------------------- predictions

def letter_logits(docs: DataFrame, bias_en: int = 0) -> DataFrame:
    """row_id, sentence, y_true (lang), logits array<double> = class-letter counts
    (``bias_en`` added to the English score), classes in SCORE_LETTERS order."""
    counts = [letter_count("text", ch).cast("double") + (F.lit(float(bias_en)) if cls == "en" else F.lit(0.0))
              for cls, ch in SCORE_LETTERS]
    return docs.select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"),
                       F.col("lang").alias("y_true"), F.array(*counts).alias("logits"))


def letter_predictions(docs: DataFrame, bias_en: int = 0) -> DataFrame:
    """row_id, y_true, y_pred: argmax of :func:`letter_logits` (first class on ties)."""
    from ..functions.vectors import argmax
    classes = F.array(*[F.lit(c) for c, _ in SCORE_LETTERS])
    lg = letter_logits(docs, bias_en)
    return lg.select("row_id", "y_true", F.element_at(classes, argmax("logits") + 1).alias("y_pred"))
