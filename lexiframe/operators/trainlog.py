"""Training logs: nested JSON history -> flat table with dynamic metric columns,
train/eval curve alignment, best checkpoint.

A log table has one row per record: ``run`` (any id columns), ``log_pos``
(position in the file) and one nullable column per key met in any record
(the JSON reader merges the keys of all records into one schema).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import sequence_number

_NUMERIC = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.DecimalType,
            T.BooleanType)
DEFAULT_BRIDGE = {"loss": "train_loss", "eval_f1": "val_f1"}


def numeric_fields(records: DataFrame, exclude: Sequence[str] = ("epoch",), id_cols: Sequence[str] = ()) -> list[str]:
    """Keys whose value is a number (or bool) somewhere.  A key that the reader inferred as
    text is kept only if its values have mixed types: ``read_trainer_log`` names such keys in
    the column's metadata (``numeric``), so a text such as "0.5" alone never makes a metric."""
    skip = set(exclude) | set(id_cols) | {"step", "log_pos"}
    return [f.name for f in records.schema.fields if f.name not in skip and (
        isinstance(f.dataType, _NUMERIC) or (f.metadata or {}).get("numeric", False))]


def flatten_log(records: DataFrame, keep: Sequence[str] | None = None, id_cols: Sequence[str] = ()) -> DataFrame:
    """One row per record that has a ``step``; columns ``step`` first, then the
    metric keys in sorted order; missing values are NULL.  ``keep`` (non-empty)
    replaces the automatic choice and may name unknown keys (NULL columns)."""
    names = set(keep) if keep else set(numeric_fields(records, id_cols=id_cols))
    names |= {"step"}
    ordered = sorted(names, key=lambda x: (x != "step", x))
    have = set(records.columns)
    cols = [F.col(n) if n in have else F.lit(None).cast("double").alias(n) for n in ordered]
    return records.where(F.col("step").isNotNull()).select(*id_cols, *cols)


def history_bridge(flat: DataFrame, keys: Sequence[str] = ("run", "step"), rename: dict | None = None) -> DataFrame:
    """Rename exporter names to the curve reader's (``loss``->``train_loss``,
    ``eval_f1``->``val_f1``) and merge the train and eval rows of one step."""
    rename = DEFAULT_BRIDGE if rename is None else rename
    df = flat.withColumnsRenamed({k: v for k, v in rename.items() if k in flat.columns})
    metrics = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in metrics])


def training_curves(records: DataFrame, keys: Sequence[str] = ("run",)) -> DataFrame:
    """k-th train loss beside the k-th eval loss and accuracy (epoch = k).

    Train records: ``loss`` present and no ``eval_loss``; eval records: ``eval_loss``
    present.  One skew-safe ordinal per (run, kind) by (step, log_pos), then one grouping by
    (run, epoch): a side that has no k-th record leaves its columns null.
    """
    k = list(keys)
    is_train = F.col("loss").isNotNull() & F.col("eval_loss").isNull()
    is_eval = F.col("eval_loss").isNotNull()
    kind = F.when(is_train, F.lit("train")).when(is_eval, F.lit("eval"))
    recs = records.select(*k, "step", "log_pos", kind.alias("__kind"), "loss", "eval_loss", "eval_accuracy") \
        .where(F.col("__kind").isNotNull())
    ranked = sequence_number(recs, k + ["__kind"], ["step", "log_pos"], out="epoch")

    def of(which: str, col: str):
        return F.max(F.when(F.col("__kind") == which, F.col(col)))

    return ranked.groupBy(*k, "epoch").agg(of("train", "loss").alias("train_loss"), of("eval", "eval_loss").alias("eval_loss"),
                                           of("eval", "eval_accuracy").alias("eval_accuracy"))


def best_checkpoint(evals: DataFrame, metric: str = "eval_f1", keys: Sequence[str] = ("run",),
                    order: str = "step") -> DataFrame:
    """Per run, the record with the greatest ``metric``; earliest ``order`` on ties.
    An aggregate (``max_by``), so a run with most of the rows is pre-aggregated."""
    cand = evals.where(F.col(metric).isNotNull())
    cols = [c for c in cand.columns if c not in keys]
    rank_key = F.struct(F.col(metric), (-F.col(order)).alias("__o"))
    best = cand.groupBy(*keys).agg(F.max_by(F.struct(*cols), rank_key).alias("__b"))
    return best.select(*keys, "__b.*")


def export_row_count(flat: DataFrame) -> DataFrame:
    """Rows written by the exporter (the count of the flat table)."""
    return flat.agg(F.count(F.lit(1)).cast("long").alias("n_rows"))
