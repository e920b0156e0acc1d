"""Classification metrics over a predictions table (``y_true``, ``y_pred``).

Everything is derived from one aggregation, the confusion counts, whose size
is (groups x classes^2) whatever the number of predictions; the rest runs on
that tiny table.  ``group`` lets one pass evaluate many candidates (epochs).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import join_on_keys


def _zero_div(a, b):
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(df: DataFrame, y: str = "y_true", p: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*group, F.col(y).alias("y_true"), F.col(p).alias("y_pred")).agg(
        F.count(F.lit(1)).cast("long").alias("n"))


def confusion_matrix(df: DataFrame, y: str = "y_true", p: str = "y_pred", labels: Sequence[str] | None = None,
                     group: Sequence[str] = ()) -> DataFrame:
    """Long, zero-filled matrix over the union of true and predicted labels (or ``labels``).

    The label frame comes from the counts and is paired with itself for the L x L spine that
    the matrix is by definition; nothing is collected.  A null label is a class of its own.
    Output: group..., y_true, y_pred, n.
    """
    counts = confusion_counts(df, y, p, group)
    if labels is None:
        both = F.array(F.struct(F.col("y_true").alias("l")), F.struct(F.col("y_pred").alias("l")))
        names = counts.select(F.explode(both).alias("e")).select("e.l").distinct()
    else:
        names = counts.sparkSession.createDataFrame([(x,) for x in labels], "l string")
    listed = names.agg(F.collect_list(F.struct("l")).alias("__l"))
    groups = counts.select(*group).distinct() if group else counts.sparkSession.range(1).select()
    spine = groups.select(*group, F.explode(listed.select("__l").scalar()).alias("a")) \
        .select(*group, F.col("a.l").alias("y_true"), F.explode(listed.select("__l").scalar()).alias("b")) \
        .select(*group, "y_true", F.col("b.l").alias("y_pred"))
    out = join_on_keys(spine, counts, list(group) + ["y_true", "y_pred"], "left")
    return out.select(*group, "y_true", "y_pred", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def class_table(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Per (group, label): tp, support (true count), predicted count — one
    aggregation: every confusion cell contributes to its true label and to its
    predicted label."""
    g = list(group)
    sides = F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(F.lit(0)).alias("tp"),
                 F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"),
                 F.lit(0).cast("long").alias("tp"), F.col("n").alias("predicted")))
    e = counts.select(*g, F.explode(sides).alias("e")).select(*g, "e.*")
    return e.groupBy(*g, "label").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "support", "predicted")])


def per_class_report(df: DataFrame, y: str = "y_true", p: str = "y_pred", group: Sequence[str] = (),
                     labels: Sequence[str] | None = None) -> DataFrame:
    """precision, recall, F1 (0 on zero denominators) and support per class.  With ``labels``
    every named class has a row, zeros where it occurs on neither side."""
    ct = class_table(confusion_counts(df, y, p, group), group)
    if labels is not None:
        groups = ct.select(*group).distinct() if group else ct.sparkSession.range(1).select()
        spine = groups.select(*group, F.explode(F.array(*[F.lit(x) for x in labels])).alias("label"))
        ct = join_on_keys(spine, ct, [*group, "label"], "full").na.fill(0, subset=["tp", "support", "predicted"])
    prec = _zero_div(F.col("tp").cast("double"), F.col("predicted").cast("double"))
    rec = _zero_div(F.col("tp").cast("double"), F.col("support").cast("double"))
    r = ct.select(*group, "label", prec.alias("precision"), rec.alias("recall"), "support")
    f1 = _zero_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return r.select(*group, "label", "precision", "recall", f1.alias("f1"), "support")


def weighted_scores(report: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision, recall, F1 (``average='weighted'``)."""
    s = F.sum("support").cast("double")
    aggs = [(F.sum(F.col(m) * F.col("support")) / s).alias(m) for m in ("precision", "recall", "f1")]
    aggs.append(F.sum("support").cast("long").alias("support"))
    return report.groupBy(*group).agg(*aggs) if group else report.agg(*aggs)


def report_with_overall(df: DataFrame, y: str = "y_true", p: str = "y_pred",
                        labels: Sequence[str] | None = None) -> DataFrame:
    """Per-class rows followed by the ``Overall`` row (weighted averages, total support)."""
    rep = per_class_report(df, y, p, labels=labels)
    overall = weighted_scores(rep).select(F.lit("Overall").alias("label"), "precision", "recall", "f1", "support")
    return rep.unionByName(overall)


def evaluate(df: DataFrame, y: str = "y_true", p: str = "y_pred", group: Sequence[str] = ()) -> DataFrame:
    """accuracy, weighted precision/recall/F1, Matthews correlation, Cohen's kappa."""
    return evaluate_counts(confusion_counts(df, y, p, list(group)), group)


def evaluate_counts(counts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """:func:`evaluate` from confusion counts (y_true, y_pred, n)."""
    g = list(group)
    ct = class_table(counts, g)
    rep = ct.select(*g, "label", "tp", "support", "predicted",
                    _zero_div(F.col("tp").cast("double"), F.col("predicted").cast("double")).alias("pr"),
                    _zero_div(F.col("tp").cast("double"), F.col("support").cast("double")).alias("rc"))
    rep = rep.withColumn("f", _zero_div(2 * F.col("pr") * F.col("rc"), F.col("pr") + F.col("rc")))
    s = F.sum("support").cast("double")
    c = F.sum("tp").cast("double")
    aggs = [
        s.alias("__s"), c.alias("__c"),
        F.sum(F.col("support").cast("double") * F.col("predicted")).alias("__tq"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("__qq"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("__tt"),
        (F.sum(F.col("pr") * F.col("support")) / s).alias("precision"),
        (F.sum(F.col("rc") * F.col("support")) / s).alias("recall"),
        (F.sum(F.col("f") * F.col("support")) / s).alias("f1"),
    ]
    a = rep.groupBy(*g).agg(*aggs) if g else rep.agg(*aggs)
    ss = F.col("__s") * F.col("__s")
    mcc_den = F.sqrt((ss - F.col("__qq")) * (ss - F.col("__tt")))
    mcc = F.when(mcc_den == 0, F.lit(0.0)).otherwise((F.col("__c") * F.col("__s") - F.col("__tq")) / mcc_den)
    kappa = F.try_divide(F.col("__c") * F.col("__s") - F.col("__tq"), ss - F.col("__tq"))
    return a.select(*g, (F.col("__c") / F.col("__s")).alias("accuracy"), "precision", "recall", "f1",
                    mcc.alias("mcc"), kappa.alias("kappa"))


def write_report(df: DataFrame, path: str, y: str = "y_true", p: str = "y_pred",
                 labels: Sequence[str] | None = None) -> None:
    """The final report as files below ``path``: matrix, classes (with Overall) and scores, one CSV each."""
    for name, table in (("matrix", confusion_matrix(df, y, p, labels)), ("classes", report_with_overall(df, y, p, labels)),
                        ("scores", evaluate(df, y, p))):
        table.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")
