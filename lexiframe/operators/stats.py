"""Numeric summaries: moments, exact quantiles, histograms, KDE, box statistics.

Grouped statistics are ``groupBy`` aggregates (map-side partial aggregation),
so a label that holds a third of all rows is pre-aggregated in every map task
instead of landing in one window partition.  Global statistics are scalar
subqueries (one row), never an unpartitioned window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import BOX_WHIS, KDE_CUT, KDE_GRIDSIZE
from ..session import reliable_checkpoint
from .quantiles import quantiles
from .ranking import join_on_keys, join_small


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# ----------------------------------------------------------------------------- moments

def group_moments(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """count, mean, population and sample deviation, min, max per key (or one row)."""
    v = F.col(value).cast("double")
    aggs = [F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std_pop"),
            F.stddev_samp(v).alias("std_samp"), F.min(v).alias("min"), F.max(v).alias("max")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def with_group_stats(df: DataFrame, stats: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Attach per-key statistics to every row.

    With keys: a null-safe equi-join with the stored statistics, which are broadcast while they
    are few (``join_small``), so the rows are not shuffled.  Without keys: the one-row
    statistics become scalar subqueries.
    """
    if keys:
        return join_small(df, stats, list(keys))
    return df.select("*", *[stats.select(F.col(c)).scalar().alias(c) for c in stats.columns])


def zscore(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "z") -> DataFrame:
    """``(x - mean) / std_pop`` (ddof=0); a zero deviation gives NULL (pandas: NaN)."""
    stats = group_moments(df, value, keys).select(*keys, "mean", "std_pop")
    s = with_group_stats(df, stats, keys)
    z = F.try_divide(F.col(value).cast("double") - F.col("mean"), F.col("std_pop"))
    return s.withColumn(out, z).drop("mean", "std_pop")


# ----------------------------------------------------------------------------- quantiles

def grouped_quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = (),
                      names: Sequence[str] | None = None) -> DataFrame:
    """Exact linear-interpolated quantiles (numpy default) per key.

    Whole numbers (lengths, counts) are counted by ``percentile``, whose buffer holds the distinct values of a group;
    every other column goes through :func:`lexiframe.operators.quantiles.quantiles`, which holds no group's values."""
    names = list(names or [f"q{int(round(p * 100))}" for p in probs])
    if not isinstance(df.schema[value].dataType, T.IntegralType):
        return quantiles(df, value, probs, keys, names)
    arr = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(float(p)) for p in probs]))
    agg = df.groupBy(*keys).agg(arr.alias("__q")) if keys else df.agg(arr.alias("__q"))
    return agg.select(*keys, *[F.col("__q")[i].alias(n) for i, n in enumerate(names)])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float]) -> dict:
    """Exact global quantiles of a column of any cardinality: ``{p: value}`` (None for an empty column)."""
    names = [f"q{i}" for i in range(len(probs))]
    row = quantiles(df, value, probs, names=names).first()
    return {p: row[n] if row else None for p, n in zip(probs, names)}


# ----------------------------------------------------------------------------- histogram

def histogram(df: DataFrame, value: str, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram over the data range, numpy rules (last bin closed,
    constant data widened by +-0.5, float edge correction), zero bins included.

    Output: keys..., bin, lo_edge, hi_edge, n.
    """
    v = F.col(value).cast("double")
    rng = df.where(v.isNotNull()).groupBy(*keys).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    rng = rng.select(*keys,
                     F.when(F.col("__lo") == F.col("__hi"), F.col("__lo") - 0.5).otherwise(F.col("__lo")).alias("__lo"),
                     F.when(F.col("__lo") == F.col("__hi"), F.col("__hi") + 0.5).otherwise(F.col("__hi")).alias("__hi"))
    step = (F.col("__hi") - F.col("__lo")) / F.lit(float(bins))

    def edge(i: Column) -> Column:
        return F.when(i >= bins, F.col("__hi")).otherwise(i.cast("double") * step + F.col("__lo"))

    if keys:
        rng = reliable_checkpoint(rng)  # read for the rows and for the bins
        rows = join_small(df.where(v.isNotNull()).select(*keys, v.alias("__x")), rng, list(keys))
    else:
        rows = df.where(v.isNotNull()).select(v.alias("__x"),
                                              rng.select("__lo").scalar().alias("__lo"),
                                              rng.select("__hi").scalar().alias("__hi"))
    norm = F.lit(float(bins)) / (F.col("__hi") - F.col("__lo"))
    i0 = F.least(((F.col("__x") - F.col("__lo")) * norm).cast("int"), F.lit(bins - 1))
    i1 = F.when(F.col("__x") < edge(i0), i0 - 1).otherwise(i0)
    i2 = F.when((F.col("__x") >= edge(i1 + 1)) & (i1 != bins - 1), i1 + 1).otherwise(i1)
    counts = rows.groupBy(*keys, i2.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = rng.select(*keys, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    spine = spine.select(*keys, "bin", edge(F.col("bin")).alias("lo_edge"), edge(F.col("bin") + 1).alias("hi_edge"))
    out = join_on_keys(spine, counts, list(keys) + ["bin"], "left")
    return out.select(*keys, F.col("bin").cast("int").alias("bin"), "lo_edge", "hi_edge",
                      F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


# ----------------------------------------------------------------------------- density

def kde(df: DataFrame, value: str, keys: Sequence[str] = (), gridsize: int = KDE_GRIDSIZE,
        cut: float = KDE_CUT, scale: str = "density", bins: int | None = None) -> DataFrame:
    """Gaussian KDE per group, Scott bandwidth ``std(ddof=1) * n**-0.2``, each group
    normalised on its own; grid ``linspace(min - cut*bw, max + cut*bw, gridsize)``.

    Work is (distinct values x gridsize): few for lengths and counts, rows x grid for
    continuous values.  Values are first counted, the grid is generated next to each counted value
    and partial sums are aggregated.  ``scale='count'`` multiplies by n x bin width, the
    width being that of ``bins`` equal bins over the group's range (the curve over its count
    histogram).  Groups with < 2 rows or zero spread
    have no density and give no rows.
    Output: keys..., grid_idx, x, density.
    """
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull())
    stats = base.groupBy(*keys).agg(F.count(v).alias("__n"), F.stddev_samp(v).alias("__sd"),
                                    F.min(v).alias("__min"), F.max(v).alias("__max"))
    stats = (stats.where((F.col("__n") >= 2) & (F.col("__sd") > 0))
             .withColumn("__bw", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
             .withColumn("__width", (F.col("__max") - F.col("__min")) / F.lit(float(bins or 1)))
             .withColumn("__g0", F.col("__min") - F.col("__bw") * cut)
             .withColumn("__g1", F.col("__max") + F.col("__bw") * cut))
    weights = base.groupBy(*keys, v.alias("__x")).agg(F.count(F.lit(1)).alias("__c"))
    step = (F.col("__g1") - F.col("__g0")) / F.lit(float(gridsize - 1))
    gx = F.when(F.col("grid_idx") == gridsize - 1, F.col("__g1")).otherwise(
        F.col("grid_idx").cast("double") * step + F.col("__g0"))
    if keys:
        w = join_small(weights, stats, list(keys))
    else:
        w = weights.select("*", *[stats.select(c).scalar().alias(c) for c in
                                  ("__n", "__bw", "__g0", "__g1", "__width")]).where(F.col("__bw").isNotNull())
    grid = w.select(*keys, "__x", "__c", "__n", "__bw", "__g0", "__g1", "__width",
                    F.explode(F.sequence(F.lit(0), F.lit(gridsize - 1))).alias("grid_idx"))
    grid = grid.withColumn("x", gx)
    u = (F.col("x") - F.col("__x")) / F.col("__bw")
    contrib = F.col("__c") * F.exp(F.lit(-0.5) * u * u)
    summed = grid.groupBy(*keys, "grid_idx", "x", "__n", "__bw", "__width").agg(F.sum(contrib).alias("__s"))
    dens = F.col("__s") / (F.col("__n") * F.col("__bw") * F.lit(math.sqrt(2 * math.pi)))
    if scale == "count":
        if not bins:
            raise ValueError("scale='count' needs the number of bins")
        dens = dens * F.col("__n") * F.col("__width")
    return summed.select(*keys, F.col("grid_idx").cast("int").alias("grid_idx"), "x", dens.alias("density"))


def kde_binned(df: DataFrame, value: str, keys: Sequence[str] = (), gridsize: int = KDE_GRIDSIZE, cut: float = KDE_CUT,
               per_bandwidth: int = 64, reach: float = 6.0) -> DataFrame:
    """:func:`kde` of continuous values: linear binning on a fine grid, then convolution with a truncated kernel.

    A value's weight is shared by the two fine nodes around it (at least ``per_bandwidth`` nodes per bandwidth, and every
    grid point is one); the nodes, not the values, meet the grid points within ``reach`` bandwidths.  Work is one
    pre-aggregated pass over the rows, then nodes x grid points in reach, however many values differ.  The density is
    within ``(0.4 / (8 per_bandwidth^2) + exp(-reach^2 / 2) * 0.4) / bandwidth`` of the plain sum.
    Output: keys..., grid_idx, x, density."""
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull() & ~F.isnan(v)).select(*keys, v.alias("__x"))
    last = gridsize - 1
    stats = base.groupBy(*keys).agg(F.count("__x").alias("__n"), F.stddev_samp("__x").alias("__sd"),
                                    F.min("__x").alias("__min"), F.max("__x").alias("__max"))
    stats = (stats.where((F.col("__n") >= 2) & (F.col("__sd") > 0))
             .withColumn("__bw", F.col("__sd") * F.pow(F.col("__n").cast("double"), F.lit(-0.2)))
             .withColumn("__g0", F.col("__min") - F.col("__bw") * cut)
             .withColumn("__g1", F.col("__max") + F.col("__bw") * cut)
             .withColumn("__per", F.ceil((F.col("__g1") - F.col("__g0")) / F.col("__bw") * per_bandwidth / last))
             .withColumn("__step", (F.col("__g1") - F.col("__g0")) / (F.col("__per") * last))
             .select(*keys, "__n", "__bw", "__g0", "__g1", "__per", "__step"))
    rows = with_group_stats(base, stats, keys).where(F.col("__bw").isNotNull())
    place = (F.col("__x") - F.col("__g0")) / F.col("__step")
    node = F.floor(place)
    shares = F.array(F.struct(node.alias("node"), (node + 1 - place).alias("w")), F.struct((node + 1).alias("node"), (place - node).alias("w")))
    nodes = rows.select(*keys, F.explode(shares).alias("__s")).groupBy(*keys, F.col("__s.node").alias("__node")) \
        .agg(F.sum("__s.w").alias("__w"))
    nodes = with_group_stats(nodes, stats, keys)
    at = F.col("__node") * F.col("__step")  # offsets from the first grid point
    coarse = F.col("__step") * F.col("__per")
    low = F.greatest(F.ceil((at - reach * F.col("__bw")) / coarse), F.lit(0))
    high = F.least(F.floor((at + reach * F.col("__bw")) / coarse), F.lit(last))
    met = nodes.where(low <= high).withColumn("grid_idx", F.explode(F.sequence(low, high)))
    u = (F.col("grid_idx") * coarse - at) / F.col("__bw")
    summed = met.groupBy(*keys, "grid_idx").agg(F.sum(F.col("__w") * F.exp(F.lit(-0.5) * u * u)).alias("__s"))
    grid = stats.select(*keys, "__n", "__bw", "__g0", "__g1", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))).alias("grid_idx"))
    out = join_on_keys(grid, summed, [*keys, "grid_idx"], "left")
    x = F.when(F.col("grid_idx") == last, F.col("__g1")).otherwise(
        F.col("grid_idx").cast("double") * ((F.col("__g1") - F.col("__g0")) / F.lit(float(last))) + F.col("__g0"))
    density = F.coalesce("__s", F.lit(0.0)) / (F.col("__n") * F.col("__bw") * F.lit(math.sqrt(2 * math.pi)))
    return out.select(*keys, F.col("grid_idx").cast("int").alias("grid_idx"), x.alias("x"), density.alias("density"))


# ----------------------------------------------------------------------------- box plot

def box_stats(df: DataFrame, value: str, keys: Sequence[str] = (), whis: float = BOX_WHIS) -> DataFrame:
    """Box-plot statistics per group: quartiles (linear), whiskers at the farthest
    data points within ``whis * IQR``, outlier count, mean.

    Output: keys..., n, mean, q1, med, q3, iqr, whislo, whishi, n_fliers.
    """
    v = F.col(value).cast("double")
    base = df.where(v.isNotNull())
    q = grouped_quantiles(base, value, [0.25, 0.5, 0.75], keys, ["q1", "med", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = q.withColumn("__loval", F.col("q1") - whis * F.col("iqr")).withColumn("__hival", F.col("q3") + whis * F.col("iqr"))
    if keys:
        rows = join_small(base.select(*keys, v.alias("__x")), q, list(keys))
    else:
        rows = base.select(v.alias("__x"), *[q.select(c).scalar().alias(c) for c in q.columns])
    # A point lies outside the whiskers exactly when it lies outside [loval, hival]
    # (the whisker is the farthest data point inside), so one pass suffices.
    agg = rows.groupBy(*keys, "q1", "med", "q3", "iqr").agg(
        F.count(F.lit(1)).alias("n"), F.avg("__x").alias("mean"),
        F.max(F.when(F.col("__x") <= F.col("__hival"), F.col("__x"))).alias("__hi"),
        F.min(F.when(F.col("__x") >= F.col("__loval"), F.col("__x"))).alias("__lo"),
        F.count_if((F.col("__x") < F.col("__loval")) | (F.col("__x") > F.col("__hival"))).alias("n_fliers"))
    whishi = F.when(F.col("__hi").isNull() | (F.col("__hi") < F.col("q3")), F.col("q3")).otherwise(F.col("__hi"))
    whislo = F.when(F.col("__lo").isNull() | (F.col("__lo") > F.col("q1")), F.col("q1")).otherwise(F.col("__lo"))
    return agg.select(*keys, "n", "mean", "q1", "med", "q3", "iqr", whislo.alias("whislo"), whishi.alias("whishi"),
                      "n_fliers")
