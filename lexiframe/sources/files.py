"""File sources and sinks: sentence CSV, text (one sentence per line), inline
sentences, nested JSON training logs, metrics-history CSV; CSV, JSON-lines and
HTML writers.  All readers are splittable Spark scans except the multi-line
formats (a CSV with quoted newlines, a JSON document), where one file is one
task by the nature of the format.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import NA_TOKENS
from ..functions.text import split_lines, strip_ws
from ..session import reliable_checkpoint
from .order import numbered_scan

SENTENCE_COLUMNS = ("sentence", "label")


def require_columns(df: DataFrame, required: Iterable[str] = SENTENCE_COLUMNS) -> DataFrame:
    """Raise unless every required column is present (schema only, no job)."""
    missing = set(required) - set(df.columns)
    if missing:
        raise ValueError(f"columns {sorted(missing)} are missing; {sorted(set(required))} are needed")
    return df


def read_sentences_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                       na_tokens: Sequence[str] = NA_TOKENS, required: Iterable[str] = SENTENCE_COLUMNS) -> DataFrame:
    """Header CSV with quoted fields (commas, doubled quotes, newlines inside).
    NA tokens become NULL in every text column.  ``row_id`` numbers the rows from 0 in the order
    of the files, by path (:func:`lexiframe.sources.order.numbered_scan`)."""
    r = (spark.read.option("header", True).option("multiLine", True).option("escape", '"')
         .option("quote", '"').option("mode", "FAILFAST"))
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", False)
    df = require_columns(r.csv(path), required)
    out = [F.when(F.col(f"`{f.name}`").isin(list(na_tokens)), F.lit(None)).otherwise(F.col(f"`{f.name}`")).alias(f.name)
           if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields]
    return numbered_scan(df, "row_id").select("row_id", *out)


def lines_to_sentences(df: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """``[l.strip() for l in t.splitlines() if l.strip()]`` for every row.
    Output: keep..., line_no (0-based position among the raw lines), sentence."""
    return (df.select(*keep, F.posexplode(split_lines(text)).alias("line_no", "__l"))
            .select(*keep, F.col("line_no").cast("int").alias("line_no"), strip_ws("__l").alias("sentence"))
            .where(F.col("sentence") != ""))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """One sentence per line: lines stripped, blank lines dropped.  The text scan
    splits files on ``\\n``/``\\r``/``\\r\\n``; the remaining Python line breaks
    (VT, FF, 0x1C-0x1E, NEL, U+2028/9) are split afterwards.
    Output: source, line_id, piece, sentence; line_id numbers the lines of all files from 0 in
    the order of the files, by path, and (line_id, piece) orders their sentences."""
    raw = numbered_scan(spark.read.text(path), "line_id", file="source")
    pieces = raw.select("source", "line_id", F.posexplode(split_lines("value")).alias("piece", "__l"))
    return pieces.select("source", "line_id", "piece", strip_ws("__l").alias("sentence")).where(F.col("sentence") != "")


def inline_sentences(spark: SparkSession, sentences: Sequence[str], strip: bool = False) -> DataFrame:
    """Sentences given in the call: as they are by default, blanks kept; ``strip`` strips
    them and leaves blank ones out, as the line reader does."""
    if strip:
        sentences = [x.strip() for x in sentences if x.strip()]
    if not sentences:
        raise ValueError("give at least one sentence")
    return spark.createDataFrame([(i, s) for i, s in enumerate(sentences)], "row_id long, sentence string")


def _field(record: str, key: str, kind: str) -> Column:
    """The value of a key of a variant record as ``kind``; null where it has another type."""
    if "'" in key and '"' in key:
        raise ValueError(f"a log key with both kinds of quotes can't be a column: {key}")
    path = f'$["{key}"]' if "'" in key else f"$['{key}']"
    return F.try_variant_get(record, path, kind)


#: Types that ``schema_of_variant`` names, and the column type they are read as; all others are read as text.
_LOG_TYPES = {"BIGINT": "bigint", "BOOLEAN": "boolean", "DOUBLE": "double", "FLOAT": "double", "DECIMAL": "double"}


def log_keys(records: DataFrame, record: str = "record") -> DataFrame:
    """key, kind, numeric, n for every key of variant records: the type that all its values share (VARIANT where they
    differ), whether one of them is a number or a boolean, and the records that have it (nulls left out).

    One aggregation over the exploded fields: no driver-side schema reading."""
    spark = records.sparkSession
    fields = records.select(F.col(record).alias("__r")).lateralJoin(
        spark.tvf.variant_explode(F.col("__r").outer())).select("key", "value")
    kind = F.schema_of_variant("value")
    known = fields.where(~F.is_variant_null("value"))
    return known.groupBy("key").agg(
        F.schema_of_variant_agg("value").alias("kind"),
        F.max(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|BOOLEAN)")).alias("numeric"), F.count(F.lit(1)).alias("n"))


def read_trainer_log(spark: SparkSession, path: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Nested training state(s): ``{"log_history": [ {...}, ... ]}``, many files at once, one state per file, or per
    line with ``lines=True`` (then files split).

    Documents are read as VARIANT: no schema is inferred from them.  Their records are stored once; keys and types come
    from one aggregation over them (:func:`log_keys`), and every key becomes a column: whole numbers, doubles, booleans,
    or text where its values are text, nested or of mixed types (``numeric`` in the column's metadata says whether one
    of them is a number).  A state without records gives no rows; what is no object in the list is left out.
    Output: source, log_pos, then one column per record key, by name (``record_`` before a key called source, log_pos
    or record)."""
    raw = spark.read.option("multiLine", not lines).option("singleVariantColumn", "state").json(path)
    records = raw.select(F.input_file_name().alias("source"), F.posexplode(
        F.try_variant_get("state", "$.log_history", "array<variant>")).alias("log_pos", "record"))
    records = records.where(F.schema_of_variant("record").startswith("OBJECT"))
    records = reliable_checkpoint(records.withColumn("log_pos", F.col("log_pos").cast("long")))
    own, columns = set(records.columns), []
    for r in sorted(log_keys(records).collect(), key=lambda r: r["key"]):
        kind = _LOG_TYPES.get(r["kind"].split("(")[0], "string")
        name = f"record_{r['key']}" if r["key"] in own else r["key"]
        columns.append(_field("record", r["key"], kind).alias(name, metadata={"numeric": r["numeric"]}))
    return records.select("source", "log_pos", *columns)


def write_trainer_log(records: DataFrame, path: str, run: str = "run", pos: str = "log_pos", part: int = 1000,
                      mode: str = "overwrite") -> None:
    """Nested training states, one JSON document per line: ``{"run": ..., "log_history": [...]}``.

    ``records`` has the run, the position in it and the column ``json`` (the record).  A run of more than ``part``
    records is written as several states, so no run is gathered whole."""
    states = records.groupBy(run, F.floor((F.col(pos) - 1) / part).alias("__part")).agg(
        F.array_sort(F.collect_list(F.struct(pos, "json"))).alias("__r"))
    history = F.array_join(F.transform("__r", lambda x: x["json"]), ",")
    line = F.concat(F.regexp_replace(F.to_json(F.struct(run)), r"\}$", ',"log_history":['), history, F.lit("]}"))
    states.select(line.alias("value")).write.mode(mode).text(path)


HISTORY_SCHEMA = "step long, train_loss double, val_f1 double"


def read_history_csv(spark: SparkSession, path: str, schema: str = HISTORY_SCHEMA) -> DataFrame:
    return spark.read.option("header", True).schema(schema).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index; a quote inside a field is doubled (``""``) as pandas does."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("quote", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON object per row, UTF-8 kept literally, null fields written."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_html(df: DataFrame, path: str, column: str = "html", mode: str = "overwrite") -> None:
    """One HTML fragment per row (per sample)."""
    df.select(column).write.mode(mode).text(path)
