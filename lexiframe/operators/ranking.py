"""Ordinals and top-k without sorting a hot key inside one task.

``sequence_number`` is ``row_number() over (partition by keys order by ...)``
rewritten so that a key holding a third of all rows is still split across
many tasks: range-partition on (keys, order), number rows locally, add the
running count of the earlier range partitions of the same key.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint


def _cols(xs) -> list[Column]:
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition ``l.k <=> r.k`` for every key (pandas groups nulls together)."""
    conds = [left[k].eqNullSafe(right[k]) for k in keys]
    return reduce(lambda a, b: a & b, conds)


def join_on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join that keeps one copy of the key columns; in right and full joins
    the key comes from whichever side has the row."""
    if not keys:
        raise ValueError("join_on_keys needs at least one key")
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys])
    out = left.join(r, cond, how)
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "left_anti"):
        out = out.withColumns({k: F.coalesce(k, f"__r_{k}") for k in keys})
    return out.drop(*[f"__r_{k}" for k in keys])


#: Rows and bytes of a frame that is broadcast.
SMALL_ROWS, SMALL_BYTES = 10_000, 4 << 20


def join_small(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", rows: int = SMALL_ROWS) -> DataFrame:
    """:func:`join_on_keys` with a frame that usually has a row per class: it is stored and measured, and broadcast while
    it has at most ``rows`` rows and ``SMALL_BYTES`` bytes, so that the rows of ``left`` are not shuffled by a few
    skewed keys.  A larger frame is joined by a shuffle, whose skewed partitions AQE splits."""
    right = reliable_checkpoint(right)
    size = right.limit(rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*right.columns)))).alias("b")) \
        .first()
    small = size["n"] <= rows and (size["b"] or 0) <= SMALL_BYTES
    return join_on_keys(left, F.broadcast(right) if small else right, keys, how)


def sequence_number(df: DataFrame, keys: Sequence[str], order: Sequence, out: str = "rn",
                    partitions: int | None = None) -> DataFrame:
    """1-based ordinal of each row inside its key, by ``order`` (must be a total order);
    with no keys, a global ordinal computed by the same range-partitioned scheme.

    Plan: one full-row exchange, RangeExchange(keys, order); every partition is sorted and
    its rows take an increasing id in the same stage; the checkpoint fixes them.  Rows per
    (key, partition) give the id of a key's first row in each partition and the rows in the
    partitions before, so that the ordinal is (id - first + before + 1): that table has at
    most keys + partitions rows and is all that is joined back.
    """
    spark = df.sparkSession
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    keys = list(keys)
    order_cols = _cols(order)
    ranged = df.repartitionByRange(n, *_cols(keys), *order_cols).sortWithinPartitions(*_cols(keys), *order_cols)
    ranged = reliable_checkpoint(ranged.withColumn("__id", F.monotonically_increasing_id())) \
        .withColumn("__pid", F.shiftright("__id", 33))
    counts = ranged.groupBy(*keys, "__pid").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__first"))
    # the offsets window runs over (keys x range partitions) rows only; without
    # keys it is a single ordering of at most ``n`` partition counts
    before = (Window.partitionBy(*keys) if keys else Window).orderBy("__pid") \
        .rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__pid", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1)
                            .alias("__off"))
    joined = join_on_keys(ranged, offsets, keys + ["__pid"])
    return joined.withColumn(out, (F.col("__id") + F.col("__off")).cast("long")).drop("__pid", "__id", "__off")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence, k: int, out: str | None = "rank") -> DataFrame:
    """First ``k`` rows per key by ``order`` (stable when ``order`` is total).

    ``row_number() <= k`` is planned as a WindowGroupLimit, so every map task
    keeps at most ``k`` rows per key before the shuffle.
    """
    w = Window.partitionBy(*keys).orderBy(*_cols(order))
    name = out or "__rank"
    res = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
    return res if out else res.drop(name)
