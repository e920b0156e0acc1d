"""Exact, seeded, stratified train/validation split.

Per class: ``n_train`` rows are taken by class quota (floor plus largest
remainder, ties by class name), the rows of a class are ordered by
``md5('<seed>:<id>')`` and the first ``quota`` go to train.  Counts per md5
prefix find the last train row of each class, so no class is ever sorted.
Deterministic: independent of partitioning and of task retries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_SEED, DEFAULT_TEST_SIZE
from .ranking import join_on_keys, join_small, sequence_number


def split_order_key(id_col: str, seed: int = DEFAULT_SEED):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))


def stratified_split(df: DataFrame, label: str, id_col: str, test_size: float = DEFAULT_TEST_SIZE,
                     seed: int = DEFAULT_SEED, out: str = "split") -> DataFrame:
    """Adds ``out`` = 'train' | 'val' (one more column on ``df``, which is scanned lazily).

    No row is ranked: each class has a cutoff (md5, id), the key of its quota-th row, and a
    row is train when its key does not exceed it.  Quotas and cutoffs are small frames, one
    row per class; see :func:`split_cutoffs`."""
    cut = split_cutoffs(df.select(label, id_col), label, id_col, test_size, seed)
    key = F.struct(split_order_key(id_col, seed).alias("h"), F.col(id_col).alias("i"))
    joined = join_small(df, cut, [label], "left")
    return joined.withColumn(out, F.when(key <= F.col("__cut"), F.lit("train")).otherwise(F.lit("val"))).drop("__cut")


def split_quotas(rows: DataFrame, label: str, test_size: float = DEFAULT_TEST_SIZE) -> DataFrame:
    """label, n, quota: rows and train rows of each class, computed by Spark on the class counts
    (floor of the proportional share plus largest remainders, ties by class name)."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    bad = counts.agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("total"), F.min("n").alias("least"),
                     F.max(F.col(label).isNull()).alias("nulls")).first()
    if not bad["classes"]:
        return counts.withColumn("quota", F.col("n"))
    if bad["nulls"]:
        raise ValueError("null label")
    total, classes = bad["total"], bad["classes"]
    n_test = int(math.ceil(test_size * total))
    n_train = total - n_test
    if bad["least"] < 2:
        raise ValueError("The least populated class has only 1 member; a stratified split needs 2")
    if n_train < classes or n_test < classes:
        raise ValueError("train and test parts must each hold at least one row per class")
    exact = F.lit(n_train) * F.col("n") / F.lit(total)
    base = counts.withColumn("__floor", F.floor(exact)).withColumn("__rest", exact - F.col("__floor"))
    left = n_train - base.agg(F.sum("__floor")).first()[0]
    ranked = sequence_number(base, [], [F.desc("__rest"), F.col(label)], out="__rank")
    return ranked.select(label, "n", (F.col("__floor") + (F.col("__rank") <= left).cast("long")).alias("quota"))


def split_cutoffs(rows: DataFrame, label: str, id_col: str, test_size: float = DEFAULT_TEST_SIZE,
                  seed: int = DEFAULT_SEED, digits: int = 5) -> DataFrame:
    """label, __cut: the (md5, id) key of the quota-th row of each class in md5 order.

    Rows are counted per (label, first ``digits`` hex digits); running sums over those
    counts name the bucket that holds the quota, and only that bucket's rows (about
    16^-digits of the class) are ordered."""
    quotas = split_quotas(rows, label, test_size).drop("n")
    keyed = rows.select(label, F.struct(split_order_key(id_col, seed).alias("h"), F.col(id_col).alias("i")).alias("__key")) \
        .withColumn("__b", F.substring("__key.h", 1, digits))
    counts = keyed.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    # counts are at most 16^digits rows per class, whatever the corpus
    run = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    ends = join_on_keys(counts.withColumn("__end", F.sum("__n").over(run)), quotas, [label])
    bucket = ends.where((F.col("__end") >= F.col("quota")) & (F.col("__end") - F.col("__n") < F.col("quota"))) \
        .select(label, "__b", (F.col("quota") - F.col("__end") + F.col("__n")).cast("int").alias("__k"))
    inside = join_small(keyed, bucket, [label, "__b"])
    return inside.groupBy(label).agg(F.sort_array(F.collect_list("__key")).alias("__keys"), F.first("__k").alias("__k")) \
        .select(label, F.element_at("__keys", F.col("__k")).alias("__cut"))
