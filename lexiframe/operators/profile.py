"""Table profiling: head, column info, describe-all summary, null counts,
duplicates, label counts in first-seen order, value counts, co-occurrence.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import split_labels
from ..session import reliable_checkpoint
from .ranking import join_on_keys, sequence_number
from .quantiles import quantiles

# Portable type names (the same words DuckDB prints for its types).
_TYPE_NAMES = {
    T.LongType: "bigint", T.IntegerType: "integer", T.ShortType: "smallint", T.ByteType: "tinyint",
    T.DoubleType: "double", T.FloatType: "float", T.StringType: "varchar", T.BooleanType: "boolean",
    T.TimestampType: "timestamp with time zone", T.TimestampNTZType: "timestamp", T.DateType: "date",
    T.BinaryType: "blob",
}


def type_name(dt: T.DataType) -> str:
    for cls, name in _TYPE_NAMES.items():
        if isinstance(dt, cls):
            return name
    if isinstance(dt, T.DecimalType):
        return f"decimal({dt.precision},{dt.scale})"
    if isinstance(dt, T.ArrayType):
        return type_name(dt.elementType) + "[]"
    return dt.simpleString()


def _missing(f: T.StructField) -> Column:
    c = F.col(f"`{f.name}`")
    return c.isNull() | F.isnan(c) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else c.isNull()


def head(df: DataFrame, n: int = 5, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """First ``n`` rows in file order (planned as a distributed TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def column_info(df: DataFrame) -> DataFrame:
    """Per column: position, name, type, non-null count (NaN is missing) — one scan, no join."""
    cells = [F.struct(F.lit(i).cast("int").alias("col_pos"), F.lit(f.name).alias("col_name"),
                      F.lit(type_name(f.dataType)).alias("col_type"),
                      F.count_if(~_missing(f)).cast("long").alias("non_null"))
             for i, f in enumerate(df.schema.fields)]
    return df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))


def null_counts(df: DataFrame) -> DataFrame:
    """``isnull().sum()`` per column (NaN is missing), one scan."""
    cells = [F.struct(F.lit(i).cast("int").alias("col_pos"), F.lit(f.name).alias("col_name"),
                      F.count_if(_missing(f)).cast("long").alias("n_null"))
             for i, f in enumerate(df.schema.fields)]
    return df.agg(F.array(*cells).alias("__c")).select(F.inline("__c"))


_SUMMARY_SCHEMA = T.StructType([
    T.StructField("col_name", T.StringType()), T.StructField("n", T.LongType()),
    T.StructField("n_unique", T.LongType()), T.StructField("top", T.StringType()),
    T.StructField("freq", T.LongType()), T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()), T.StructField("min_v", T.DoubleType()),
    T.StructField("p25", T.DoubleType()), T.StructField("p50", T.DoubleType()),
    T.StructField("p75", T.DoubleType()), T.StructField("max_v", T.DoubleType()),
])

_NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType)


def _numeric_view(f: T.StructField) -> Column | None:
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, _NUMERIC):
        return F.nanvl(c.cast("double"), F.lit(None).cast("double"))
    if isinstance(f.dataType, T.TimestampNTZType):
        # wall-clock timestamps: read as UTC whatever the session time zone is
        utc = F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
        return F.unix_micros(utc).cast("double") / F.lit(86400e6)
    if isinstance(f.dataType, T.TimestampType):
        # datetimes are summarised as fractional days since the epoch (UTC)
        return F.unix_micros(c).cast("double") / F.lit(86400e6)
    if isinstance(f.dataType, T.DateType):
        return F.unix_date(c).cast("double")
    return None


def summary(df: DataFrame, digits: int | None = None) -> DataFrame:
    """``describe(include='all')`` as one row per column.

    Categorical columns (strings, booleans): n, n_unique, top, freq (ties: smallest
    value).  Numeric and datetime columns: n, mean, std (ddof=1), min, exact
    linear quartiles, max; NaN is missing, values are taken as doubles.  Cells that do
    not apply are NULL.

    Plan (a fixed number of passes, whatever the columns hold):
    1. numeric columns are unpivoted to (column, value) while they are scanned; one aggregation
       gives n, mean, std, min and max, another a sketch per column;
    2. one scan counts the values around the brackets that the sketches give for the quartiles,
       and only the values inside are written and ordered (``operators.quantiles``): no value
       of the table is shuffled;
    3. categorical columns are counted by two 64-bit hashes of the value, so no text is
       shuffled for the counts; the top value is the least text among the rows with a most
       frequent pair of hashes.
    """
    spark = df.sparkSession
    fields = df.schema.fields
    numeric = [(f, _numeric_view(f)) for f in fields if _numeric_view(f) is not None]
    categorical = [f for f in fields if _numeric_view(f) is None]
    rows = {}

    def r(x):
        if x is None:
            return None
        return float(x) if digits is None else round(float(x), digits)

    if numeric:
        long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), c.alias("v"))
                                               for i, (_, c) in enumerate(numeric)])).alias("e")).select("e.c", "e.v")
        long = long.where(F.col("v").isNotNull() & ~F.isnan("v"))
        first = {x["c"]: x for x in long.groupBy("c").agg(
            F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("mean"),
            F.stddev_samp("v").alias("std")).collect()}
        quart = {x["c"]: list(x)[1:] for x in quantiles(long, "v", (0.25, 0.5, 0.75), ["c"]).collect()} if first else {}
        for i, (f, _) in enumerate(numeric):
            if i not in first:
                rows[f.name] = (f.name, 0, None, None, None, None, None, None, None, None, None, None)
                continue
            x = first[i]
            rows[f.name] = (f.name, x["n"], None, None, None, r(x["mean"]), r(x["std"]), r(x["lo"]),
                            *[r(q) for q in quart[i]], r(x["hi"]))
    if categorical:
        cells = F.explode(F.array(*[F.struct(F.lit(j).alias("c"), F.col(f"`{f.name}`").cast("string").alias("v"))
                                    for j, f in enumerate(categorical)]))
        long = df.select(cells.alias("e")).select("e.c", "e.v").where(F.col("v").isNotNull()) \
            .withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
        counts = reliable_checkpoint(long.groupBy("c", "h", "h2").agg(F.count(F.lit(1)).alias("cnt")))
        got = {row["c"]: row for row in counts.groupBy("c").agg(
            F.sum("cnt").alias("n"), F.count(F.lit(1)).alias("u"), F.max("cnt").alias("freq")).collect()}
        # where every value is unique any text may be the top one; elsewhere only the most frequent hashes' texts
        unique = [c for c, g in got.items() if g["freq"] == 1]
        often = [(F.col("c") == c) & (F.col("cnt") == g["freq"]) for c, g in got.items() if g["freq"] > 1]
        texts = long.where(F.col("c").isin(unique)).select("c", "v")
        if often:
            best = counts.where(reduce(lambda a, b: a | b, often)).select("c", "h", "h2")
            texts = texts.unionByName(long.where(~F.col("c").isin(unique)).join(best, ["c", "h", "h2"], "left_semi").select("c", "v"))
        top = {row["c"]: row["v"] for row in texts.groupBy("c").agg(F.min("v").alias("v")).collect()}
        for j, f in enumerate(categorical):
            g = got.get(j)
            rows[f.name] = (f.name, g["n"] if g else 0, g["u"] if g else 0, top.get(j),
                            g["freq"] if g else None, None, None, None, None, None, None, None)
    ordered = [rows[f.name] for f in fields]
    return spark.createDataFrame(ordered, _SUMMARY_SCHEMA)


def duplicate_rows(df: DataFrame, subset: Sequence[str], out: str = "dup_count") -> DataFrame:
    """All members of duplicate groups (``duplicated(keep=False)``), nulls equal,
    each row with its group size.

    A first aggregation runs over 64-bit hashes only, so full keys (long texts)
    are shuffled just for rows whose hash repeats; those candidates are
    checkpointed once, and the exact grouping on them removes hash collisions.
    """
    subset = list(subset)
    h = df.withColumn("__h", F.xxhash64(*[F.col(c) for c in subset]))
    repeated = h.groupBy("__h").agg(F.count(F.lit(1)).alias("__hn")).where(F.col("__hn") > 1).select("__h")
    # Candidates (rows whose hash repeats) are read twice below; materialise them
    # once in the checkpoint folder instead of scanning the source a third time.
    cand = reliable_checkpoint(h.join(repeated, "__h", "left_semi"))
    groups = cand.groupBy("__h", *subset).agg(F.count(F.lit(1)).alias(out)).where(F.col(out) > 1)
    return join_on_keys(cand, groups, ["__h"] + subset).drop("__h")


def duplicate_report(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """One row: rows that belong to duplicate groups and the number of such groups.

    Keys are compared by two 64-bit hashes, so no text is shuffled or stored for two numbers."""
    cols = [F.col(c) for c in subset]
    # nulls do not change a hash: their positions are hashed as well
    nulls = [F.col(c).isNull() for c in subset]
    keyed = df.select(F.xxhash64(*cols, *nulls).alias("h1"), F.xxhash64(F.lit(1), *cols, *nulls).alias("h2"))
    groups = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    return groups.agg(F.coalesce(F.sum("__n"), F.lit(0)).cast("long").alias("n_dup_rows"),
                      F.count(F.lit(1)).cast("long").alias("n_dup_groups"))


def drop_nulls(df: DataFrame, columns: Sequence[str], on_null: str = "error") -> DataFrame:
    """The null policy of text steps: ``'drop'`` leaves rows with a null in ``columns`` out,
    ``'error'`` raises when such a row is met (while the rows stream by, without a pass of its own)."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])
    if on_null == "drop":
        return df.where(~bad)
    if on_null != "error":
        raise ValueError("on_null is 'error' or 'drop'")
    message = F.lit(f"null in one of {list(columns)}")
    return df.withColumns({c: F.coalesce(c, F.raise_error(message).cast(df.schema[c].dataType)) for c in columns})


def explode_labels(df: DataFrame, label: str = "label", sep: str = ",", out: str = "label_item",
                   pos: str | None = "label_pos", trim_labels: bool = False, on_null: str = "error") -> DataFrame:
    """One row per list element; every other column repeated (bag semantics).
    A null label raises, or leaves its row out with ``on_null='drop'``."""
    df = drop_nulls(df, [label], on_null)
    arr = split_labels(label, sep, trim_labels)
    if pos:
        return df.select("*", F.posexplode(arr).alias(pos, out))
    return df.select("*", F.explode(arr).alias(out))


def label_counts(df: DataFrame, label: str = "label", id_col: str = "row_id", sep: str = ",") -> DataFrame:
    """Flattened label counts, with first-seen order (``Counter`` over the lists).

    Output: label, n, seen_order (1 = first label met in file order).
    The order is a range-partitioned global ordinal over the distinct labels.
    """
    e = explode_labels(df.select(id_col, label), label, sep)
    agg = e.groupBy(F.col("label_item").alias("label")).agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.min(F.struct(F.col(id_col), F.col("label_pos"))).alias("__first"))
    ranked = sequence_number(agg, [], [F.col("__first")], out="seen_order")
    return ranked.select("label", "n", "seen_order")


def value_counts(df: DataFrame, col: str, out: str = "n") -> DataFrame:
    """Rows per value, descending count (ties by value)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).cast("long").alias(out)).orderBy(F.desc(out), F.col(col))


def cooccurrence(df: DataFrame, label: str = "label", sep: str = ",") -> DataFrame:
    """:func:`cooccurrence_lists` over a column of ``sep``-joined labels."""
    return cooccurrence_lists(df.select(split_labels(label, sep).alias("items")))


def cooccurrence_items(items: DataFrame, row: str = "row_id", label: str = "label_item") -> DataFrame:
    """Co-occurrence from an exploded (row, label) table: per row, every ordered pair of its
    labels weighted by their multiplicities.  Rows are first reduced to one map of label
    counts each (partial sums, so a row with a third of all items is pre-aggregated), then
    the map is exploded twice.  Output (non-zero cells): label_a, label_b, n."""
    m = items.groupBy(row, label).agg(F.count(F.lit(1)).alias("__m"))
    per = m.groupBy(row).agg(F.collect_list(F.struct(F.col(label).alias("l"), F.col("__m").alias("m"))).alias("__l"))
    lists = per.groupBy(F.array_sort("__l").alias("__l")).agg(F.count(F.lit(1)).alias("__rows"))
    a = lists.select("__l", "__rows", F.explode("__l").alias("a"))
    pairs = a.select("a", F.explode("__l").alias("b"), "__rows")
    return pairs.groupBy(F.col("a.l").alias("label_a"), F.col("b.l").alias("label_b")).agg(
        F.sum(F.col("a.m") * F.col("b.m") * F.col("__rows")).cast("long").alias("n"))


def cooccurrence_lists(df: DataFrame, items: str = "items") -> DataFrame:
    """Co-occurrence from an array column: every ordered pair of one row's elements counts,
    so a label twice in a row adds 4 to its diagonal.  Two explodes of the row's own list;
    rows are first reduced to distinct lists with their counts.
    Output (non-zero cells): label_a, label_b, n."""
    lists = df.groupBy(F.col(items).alias("__l")).agg(F.count(F.lit(1)).alias("__rows"))
    one = lists.select("__l", "__rows", F.explode("__l").alias("label_a"))
    return one.select("label_a", F.explode("__l").alias("label_b"), "__rows") \
        .groupBy("label_a", "label_b").agg(F.sum("__rows").cast("long").alias("n"))


def dense_cooccurrence(pairs: DataFrame) -> DataFrame:
    """The square form as rows: every pair of the labels that occur, zero-filled."""
    listed = pairs.agg(F.collect_set("label_a").alias("__l"))
    spine = pairs.select("label_a").distinct().select("label_a", F.explode(listed.select("__l").scalar()).alias("label_b"))
    out = join_on_keys(spine, pairs, ["label_a", "label_b"], "left")
    return out.select("label_a", "label_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def cooccurrence_matrix(pairs: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Dense square form, zero-filled, one column per given label (pivot with explicit values)."""
    return (pairs.groupBy("label_a").pivot("label_b", list(labels)).agg(F.sum("n"))
            .na.fill(0, subset=list(labels)))
