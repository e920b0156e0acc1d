"""Exact quantiles by selection: sketches bracket a rank, one pass counts around the bracket, the rest narrows down.

No value is sorted globally and no group's values are held in one place: a KLL sketch per group (mergeable, a few
kilobytes) gives a lower and an upper value around each wanted rank.  One scan counts the values below, at and between
them, which settles ranks that fall on a bracket's end (ties, few distinct values) and tells how many values lie
strictly between.  Those, about 2 % of the group, are written and narrowed down again, until at most ``LEAF``
values are left to be ordered.  The sketch only steers: counts are exact, and a rank that its bracket missed is sought
on the side where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .ranking import SMALL_ROWS, join_on_keys

#: Size of a sketch (rank error about 0.4 %), points that are read from it, points that a bracket spans to each side,
#: values that are ordered.
SKETCH_K, GRID, STEPS, LEAF = 800, 200, 2, 1 << 16


def _attach(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    return join_on_keys(left, F.broadcast(right) if small else right, keys)


def _sketches(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, bool]:
    """keys, n, grid (values at evenly spaced ranks) of every group, stored; and whether they are few."""
    points = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    out = reliable_checkpoint(rows.groupBy(*keys).agg(F.count("v").alias("n"), F.kll_sketch_agg_double("v", SKETCH_K).alias("__s"))
                              .select(*keys, "n", F.kll_sketch_get_quantile_double("__s", points).alias("grid")))
    return out, out.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS


def _places(rows: DataFrame, keys: Sequence[str], sketches: DataFrame, small: bool, ranks: Sequence[Column]) -> DataFrame:
    """keys, slot, rank, value or the open interval that holds the rank: above, under, values before it, values in it."""
    def at(rank: Column, round_, by: int) -> Column:
        place = round_(rank / F.greatest(F.col("n") - 1, F.lit(1)) * GRID) + by
        return F.element_at("grid", F.least(F.greatest(place, F.lit(0)), F.lit(GRID)).cast("int") + 1)

    slots = range(len(ranks))
    brackets = sketches.select(*keys, *[x for i in slots for x in (
        ranks[i].alias(f"rank{i}"), at(ranks[i], F.floor, -STEPS).alias(f"lo{i}"), at(ranks[i], F.ceil, STEPS).alias(f"hi{i}"))])
    v, names = F.col("v"), ("rank", "lo", "hi", "below_lo", "to_lo", "below_hi", "to_hi")
    counts = _attach(rows, brackets, keys, small).groupBy(*keys).agg(*[x for i in slots for x in (
        *[F.first(f"{name}{i}").alias(f"{name}{i}") for name in names[:3]],
        F.count_if(v < F.col(f"lo{i}")).alias(f"below_lo{i}"), F.count_if(v <= F.col(f"lo{i}")).alias(f"to_lo{i}"),
        F.count_if(v < F.col(f"hi{i}")).alias(f"below_hi{i}"), F.count_if(v <= F.col(f"hi{i}")).alias(f"to_hi{i}"))])
    cells = F.array(*[F.struct(F.lit(i).alias("slot"), *[F.col(f"{x}{i}").alias(x) for x in names]) for i in slots])
    each = counts.select(*keys, F.explode(cells).alias("__c"))
    each = each.select(*keys, *[F.col(f"__c.{x}") for x in (*(() if "slot" in keys else ("slot",)), *names)])
    r = F.col("rank")
    value = F.when((r >= F.col("below_lo")) & (r < F.col("to_lo")), F.col("lo")) \
        .when((r >= F.col("below_hi")) & (r < F.col("to_hi")), F.col("hi"))
    no, low, mid = F.lit(None), r < F.col("below_lo"), r < F.col("below_hi")
    return each.select(
        *keys, *(() if "slot" in keys else ("slot",)), "rank", value.alias("value"),
        F.when(low, no).when(mid, F.col("lo")).otherwise(F.col("hi")).alias("above"),
        F.when(low, F.col("lo")).when(mid, F.col("hi")).alias("under"),
        F.when(low, F.lit(0)).when(mid, F.col("to_lo")).otherwise(F.col("to_hi")).alias("before"),
        F.when(low, F.col("below_lo")).when(mid, F.col("below_hi")).alias("end"))


def selected_values(rows: DataFrame, keys: Sequence[str], ranks: Callable[[Column], Sequence[Column]],
                    leaf: int = LEAF) -> DataFrame:
    """keys, n, slot, value: the values at the 0-based ranks that ``ranks`` names for a group of n, in the group's order.

    ``rows`` has the keys and ``v``: doubles, neither null nor NaN."""
    keys = list(keys)
    sizes, small = sketches, few = _sketches(rows, keys)
    places = reliable_checkpoint(_places(rows, keys, sketches, small, ranks(F.col("n"))))
    found, by = [], keys
    while True:
        found.append(places.where(F.col("value").isNotNull()).select(*keys, "slot", "value"))
        left = places.where(F.col("value").isNull()).select(
            *keys, "slot", (F.col("rank") - F.col("before")).alias("rank"), "above", "under",
            F.coalesce(F.col("end") - F.col("before") <= leaf, F.lit(False)).alias("few"))
        most = left.agg(F.count(F.lit(1)), F.count_if(~F.col("few"))).first()
        if not most[0]:
            break
        held = (F.col("above").isNull() | (F.col("v") > F.col("above"))) & (F.col("under").isNull() | (F.col("v") < F.col("under")))
        rows = reliable_checkpoint(_attach(rows, left, by, small).where(held).select(*keys, "slot", "v", "rank", "few"))
        by = [*keys, "slot"]
        last = rows.where("few").groupBy(*by).agg(F.sort_array(F.collect_list("v")).alias("v"), F.first("rank").alias("rank"))
        found.append(last.select(*by, F.element_at("v", (F.col("rank") + 1).cast("int")).alias("value")))
        if not most[1]:
            break
        rows = rows.where(~F.col("few")).select(*by, "v")
        sketches, small = _sketches(rows, by)
        wanted = left.where(~F.col("few")).select(*by, "rank")
        places = _places(rows, by, _attach(sketches, wanted, by, small), small, [F.col("rank")])
        places = reliable_checkpoint(places)
    return _attach(reduce(DataFrame.unionByName, found), sizes.select(*keys, "n"), keys, few)


def quantiles(df: DataFrame, value: str | Column, probs: Sequence[float], keys: Sequence[str] = (),
              names: Sequence[str] | None = None, leaf: int = LEAF) -> DataFrame:
    """keys..., one column per probability: exact linear-interpolated quantiles of the values that are neither null nor
    NaN (a group without any has no row).  Work is a few scans, whatever the values; a group may hold most rows."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    own = [f"__k{i}" for i in range(max(1, len(keys)))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*[(F.col(k) if keys else F.lit(0)).alias(o) for k, o in zip(keys or own, own)], v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))

    def position(p: float, n: Column) -> Column:
        return F.lit(float(p)) * (n - 1)

    values = selected_values(rows, own, lambda n: [f(position(p, n)).cast("long") for p in probs for f in (F.floor, F.ceil)], leaf)
    wide = values.groupBy(*own, "n").agg(*[F.max(F.when(F.col("slot") == s, F.col("value"))).alias(f"v{s}")
                                           for s in range(2 * len(probs))])
    part = [position(p, F.col("n")) - F.floor(position(p, F.col("n"))) for p in probs]
    return wide.select(*[F.col(o).alias(k) for k, o in zip(keys, own)], *[(F.col(f"v{2 * i}") + (F.col(f"v{2 * i + 1}") - F.col(f"v{2 * i}")) * part[i]).alias(name)
                                                                     for i, name in enumerate(names)])
