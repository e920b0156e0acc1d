"""z-scores and outlier trimming (global and per label), and the two bag unions
built on them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import Z_LIMIT
from ..functions.text import contains_text
from .ranking import join_small
from .stats import group_moments, with_group_stats, zscore


def trim_outliers(df: DataFrame, value: str, keys: Sequence[str] = (), limit: float = Z_LIMIT,
                  z: str = "z", keep_z: bool = False) -> DataFrame:
    """Keep ``abs(z) <= limit``; an undefined z (constant group) drops the row, as NaN does."""
    out = zscore(df, value, keys, out=z).where(F.abs(F.col(z)) <= limit)
    return out if keep_z else out.drop(z)


def trim_by_label(exploded: DataFrame, label: str, value: str, trim: Sequence[str] | None = None,
                  keep: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """Per-label trimming in one pass: labels in ``trim`` keep only their inliers
    (z inside the label), labels in ``keep`` are kept whole, every other label is
    dropped.  ``trim=None`` trims every label.

    The per-label statistics come from one aggregation over the trimmed labels
    and are joined back (no window partitioned by label, so a hot label does not
    end up in a single task).
    """
    cand = exploded if trim is None else exploded.where(F.col(label).isin(list(trim)))
    stats = group_moments(cand, value, [label]).select(label, "mean", "std_pop")
    z = F.try_divide(F.col(value).cast("double") - F.col("mean"), F.col("std_pop"))
    if trim is None:
        return with_group_stats(exploded, stats, [label]).where(F.abs(z) <= limit).drop("mean", "std_pop")
    joined = join_small(exploded, stats, [label], "left")
    keep_cond = F.col(label).isin(list(keep)) if keep else F.lit(False)
    trim_cond = F.col(label).isin(list(trim)) & (F.abs(z) <= limit)
    return joined.where(keep_cond | trim_cond).drop("mean", "std_pop")


def union_mixed(df: DataFrame, label: str, value: str, needle: str = "Task", limit: float = Z_LIMIT,
                dedup: bool = False) -> DataFrame:
    """Rows whose raw label string does not contain ``needle`` (substring test),
    followed by all rows whose global z is inside ``limit`` — a bag: rows meeting
    both conditions appear twice.  ``dedup=True`` gives each row once.
    """
    scored = zscore(df, value, out="__z")
    lacks = ~contains_text(F.col(label), needle)
    inlier = F.abs(F.col("__z")) <= limit
    if dedup:
        return scored.where(lacks | F.coalesce(inlier, F.lit(False))).drop("__z")
    return scored.where(lacks).drop("__z").unionByName(scored.where(inlier).drop("__z"))
