"""One training run in epochs: mini-batch AdamW softmax regression over hashed words.

Features are computed once and stored by batch.  A step is one Spark job over one batch: its tasks add up the gradient
of their rows, the cells are summed by key, and the driver, which holds nothing but the parameters and their moments
(classes x features numbers), makes the update.  Every epoch reads every batch once, is evaluated, and its weights are
kept; a lost executor repeats tasks of one step.  A task works on slices of its Arrow batches, of about ``SLICE``
entries, so that its Python needs no more memory for more or longer rows than one of Spark's batches takes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..session import reliable_checkpoint, scratch_path
from .metrics import evaluate_counts
from .ranking import sequence_number

FEATURES = 1 << 16

#: Rows and list entries that a task works on at a time; a longer row is a slice of its own.
SLICE = 1 << 18


# ----------------------------------------------------------------------------- features

def hashed_words(text: str | Column, features: int = FEATURES, lowercase: bool = True) -> Column:
    """Feature number of every word between white space: the first 32 bits of its MD5, modulo ``features``."""
    t = F.col(text) if isinstance(text, str) else text
    t = F.coalesce(F.lower(t) if lowercase else t, F.lit(""))
    return F.transform(words(t), lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long") % features).cast("int"))


VECTOR = "struct<indices:array<int>,weights:array<double>>"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), offsets - offsets[0]


def _slices(column: pa.Array) -> Iterator[slice]:
    """Ranges of a list column's rows, each of at most ``SLICE`` rows and entries or one row."""
    before = column.offsets.to_numpy().astype(np.int64) + np.arange(len(column) + 1)
    start = 0
    while start < len(column):
        stop = max(start + 1, int(np.searchsorted(before, before[start] + SLICE, "right")) - 1)
        yield slice(start, stop)
        start = stop


def _unit_vector(hashed: pa.Array) -> pa.Array:
    index, first = _lists(hashed)
    owner = np.repeat(np.arange(len(hashed), dtype=np.int64), np.diff(first))
    key, tf = np.unique(owner << 32 | index.astype(np.int64), return_counts=True)
    owner, weight = key >> 32, np.log1p(tf)
    norm = np.sqrt(np.bincount(owner, weight * weight, len(hashed)))
    first = pa.array(np.searchsorted(owner, np.arange(len(hashed) + 1)), pa.int32())
    return pa.StructArray.from_arrays(
        [pa.ListArray.from_arrays(first, pa.array(key & 0xFFFFFFFF, pa.int32())),
         pa.ListArray.from_arrays(first, pa.array(weight / norm[owner], pa.float64()))], ["indices", "weights"])


def _unit_vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for hashed in batches:
        for rows in _slices(hashed):
            yield _unit_vector(hashed[rows])


def text_vectors(df: DataFrame, text: str = "sentence", features: int = FEATURES, keep: Sequence[str] = ()) -> DataFrame:
    """keep..., indices, weights: ``log(1 + tf)`` of the hashed words, scaled to length one (an empty text: no entries)."""
    return df.select(*keep, F.arrow_udf(_unit_vectors, VECTOR)(hashed_words(text, features)).alias("__v")).select(*keep, "__v.*")


# ----------------------------------------------------------------------------- the model

@dataclass
class SoftmaxModel:
    """Class names, weights (features x classes) and bias."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, indices: np.ndarray, first: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Rows x classes, for rows of ragged entries."""
        rows = len(first) - 1
        owner = np.repeat(np.arange(rows), np.diff(first))
        logits = np.stack([np.bincount(owner, weights * self.weights[indices, c], rows) + self.bias[c]
                           for c in range(len(self.classes))], axis=1)
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class AdamW:
    """Adam with decoupled weight decay, bias correction, and clipping to a global norm, over a list of arrays."""

    def __init__(self, params: list[np.ndarray], decay: float = 0.0, clip: float | None = 1.0, beta1: float = 0.9,
                 beta2: float = 0.999, eps: float = 1e-8):
        self.params, self.decay, self.clip, self.beta1, self.beta2, self.eps = params, decay, clip, beta1, beta2, eps
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        self.steps = 0

    def step(self, gradients: list[np.ndarray], lr: float) -> None:
        self.steps += 1
        if self.clip is not None:
            norm = math.sqrt(sum(float((g * g).sum()) for g in gradients))
            gradients = [g * min(1.0, self.clip / (norm + 1e-6)) for g in gradients]
        for p, g, (m, v) in zip(self.params, gradients, self.moments):
            p *= 1 - lr * self.decay
            m += (1 - self.beta1) * (g - m)
            v += (1 - self.beta2) * (g * g - v)
            p -= lr * (m / (1 - self.beta1 ** self.steps)) / (np.sqrt(v / (1 - self.beta2 ** self.steps)) + self.eps)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """y, indices, offsets of the rows and weights, by slices of batches (y, indices, weights)."""
    for batch in batches:
        y, indices, weights = batch.columns
        for rows in _slices(indices):
            yield (y[rows].to_numpy(zero_copy_only=False).astype(np.int64), *_lists(indices[rows]), _lists(weights[rows])[0])


def _gradient_task(model):
    """mapInArrow over (y, indices, weights): cell, value sums of the task; cell -1 holds the loss, -2 the rows.
    Cells number (feature, class); the features after the last one are the bias."""
    def run(batches):
        own = model.value
        k, size = len(own.classes), len(own.weights)
        total = np.zeros((size + 1, k))
        loss, rows = 0.0, 0
        for y, indices, first, weights in _rows(batches):
            p = own.probabilities(indices, first, weights)
            loss -= np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
            rows += len(y)
            p[np.arange(len(y)), y] -= 1.0
            owner = np.repeat(np.arange(len(y)), np.diff(first))
            for c in range(k):
                total[:size, c] += np.bincount(indices, weights * p[owner, c], size)
            total[size] += p.sum(axis=0)
        cell = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(cell, [-1, -2])),
                                          pa.array(np.append(total.ravel()[cell], [loss, rows]))], ["cell", "value"])
    return run


def _score_task(model):
    """mapInArrow over (y, indices, weights): y_true, y_pred, n, nll of the task."""
    def run(batches):
        own = model.value
        k = len(own.classes)
        n, nll = np.zeros(k * k, np.int64), np.zeros(k * k)
        for y, indices, first, weights in _rows(batches):
            p = own.probabilities(indices, first, weights)
            cell = y * k + p.argmax(axis=1)
            n += np.bincount(cell, minlength=k * k)
            nll += np.bincount(cell, -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)), k * k)
        cell = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(cell // k), pa.array(cell % k), pa.array(n[cell]), pa.array(nll[cell])],
                                         ["y_true", "y_pred", "n", "nll"])
    return run


# ----------------------------------------------------------------------------- the run

def _coded(df: DataFrame, classes: list[str], label: str) -> DataFrame:
    known = F.array(*[F.lit(c) for c in classes])
    code = F.array_position(known, F.col(label)) - 1
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label), F.lit("null")))).cast("long")
    return df.withColumn("y", F.when(code >= 0, code).otherwise(unseen))


def _store(df: DataFrame, name: str, *by: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def batches_of(rows: DataFrame, row: str, batches: int, n: int, seed: int) -> DataFrame:
    """``rows`` (n of them) with ``batch``: 0 .. batches-1, of equal size but for one row, in a seeded random order."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(row).cast("string")))
    ranked = sequence_number(rows.withColumn("__key", key), [], ["__key", row], out="__rn")
    return ranked.withColumn("batch", F.floor((F.col("__rn") - 1) * batches / n).cast("int")).drop("__rn", "__key")


def batch_order(batches: int, epoch: int, seed: int) -> list[int]:
    """The order of the batches in an epoch: by the MD5 of ``seed:epoch:batch``."""
    import hashlib

    return sorted(range(batches), key=lambda b: hashlib.md5(f"{seed}:{epoch}:{b}".encode()).hexdigest())


@dataclass
class Run:
    """What a run leaves: the log records, confusion counts per epoch, the best epoch and its model, where weights are."""

    log: DataFrame
    confusion: DataFrame
    best_epoch: int
    model: SoftmaxModel
    path: str


LOG_SCHEMA = ("run string, step long, log_pos long, epoch double, learning_rate double, loss double, eval_loss double, "
              "eval_accuracy double, eval_precision double, eval_recall double, eval_f1 double, eval_mcc double, "
              "eval_kappa double")


def train_epochs(train: DataFrame, val: DataFrame, epochs: int = 5, lr: float = 0.05, batch_size: int | None = None,
                 batches: int | None = None, seed: int = 42, schedule: str = "linear", weight_decay: float = 0.0,
                 clip: float | None = 1.0, text: str = "sentence", label: str = "label", row: str = "row_id",
                 features: int = FEATURES, path: str | None = None, run: str = "run") -> Run:
    """Trains once over ``epochs`` epochs of mini-batches and keeps the weights of every epoch under ``path``.

    An epoch is ``batches`` batches, or as many as rows of ``batch_size`` need (neither: one full batch); rows are dealt
    in a seeded random order, whose batches are taken in another order each epoch.  The learning rate falls linearly to
    0 over all steps (``schedule='constant'``: stays).  Each epoch logs a train record (mean loss of its rows as they
    were met) and an eval record, as ``flatten_log`` and ``training_curves`` read them.  The best epoch has the greatest
    weighted F1, the earliest on ties.  Null texts are empty; an unseen or null label raises."""
    spark = train.sparkSession
    classes = [r[0] for r in train.select(label).distinct().orderBy(label).collect()]
    if None in classes:
        raise ValueError("null label")
    # stored before they are dealt to batches: the ranges of the order sample their input
    vectors = reliable_checkpoint(text_vectors(_coded(train, classes, label), text, features, keep=[row, "y"]))
    n = vectors.count()
    if not n:
        raise ValueError("no rows to train on")
    batches = min(n, batches or (-(-n // batch_size) if batch_size else 1))
    stored = _store(batches_of(vectors, row, batches, n, seed), "train-batches", "batch")
    held_out = reliable_checkpoint(text_vectors(_coded(val, classes, label), text, features, keep=["y"]))
    path = path or scratch_path(spark, "epochs")
    model = SoftmaxModel(classes, np.zeros((features, len(classes))), np.zeros(len(classes)))
    optimizer = AdamW([model.weights, model.bias], weight_decay, clip)
    records, counts, best = [], [], None
    for epoch in range(1, epochs + 1):
        loss = 0.0
        for b in batch_order(batches, epoch, seed):
            total_steps = epochs * batches
            rate = lr * (1 - optimizer.steps / total_steps) if schedule == "linear" else lr
            gradient, batch_loss = _gradient(stored.where(F.col("batch") == b), model)
            optimizer.step(gradient, rate)
            loss += batch_loss
        scored = _confusion(held_out, model)
        counts += [(epoch, classes[r["y_true"]], classes[r["y_pred"]], r["n"], r["nll"]) for r in scored]
        frame = spark.createDataFrame([(r["y_true"], r["y_pred"], r["n"]) for r in scored],
                                      "y_true long, y_pred long, n long")
        scores = evaluate_counts(frame).first() if scored else None
        measures = [scores[m] for m in ("accuracy", "precision", "recall", "f1", "mcc", "kappa")] if scored else [None] * 6
        seen = sum(r["n"] for r in scored)
        records.append((run, optimizer.steps, 2 * epoch - 1, float(epoch), rate, loss / n, *[None] * 7))
        records.append((run, optimizer.steps, 2 * epoch, float(epoch), None, None,
                        sum(r["nll"] for r in scored) / seen if seen else None, *measures))
        _save(spark, model, path, epoch)
        f1 = measures[3] if measures[3] is not None else -1.0
        if best is None or f1 > best[0]:
            best = f1, epoch, SoftmaxModel(classes, model.weights.copy(), model.bias.copy())
    confusion = spark.createDataFrame(counts, "epoch int, y_true string, y_pred string, n long, nll double")
    return Run(spark.createDataFrame(records, LOG_SCHEMA), confusion, best[1], best[2], path)


def _gradient(rows: DataFrame, model: SoftmaxModel) -> tuple[list[np.ndarray], float]:
    """Mean gradient of the batch for weights and bias, and its summed loss."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    parts = rows.select("y", "indices", "weights").mapInArrow(_gradient_task(sent), "cell long, value double")
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    sent.destroy()
    cell, value = (cells.column(i).to_numpy() for i in (0, 1))
    k, size = len(model.classes), len(model.weights)
    loss, n = float(value[cell == -1].sum()), float(value[cell == -2].sum())
    dense = np.zeros((size + 1) * k)
    dense[cell[cell >= 0]] = value[cell >= 0] / n
    dense = dense.reshape(size + 1, k)
    return [dense[:size], dense[size]], loss


def _confusion(rows: DataFrame, model: SoftmaxModel) -> list:
    sent = rows.sparkSession.sparkContext.broadcast(model)
    parts = rows.select("y", "indices", "weights").mapInArrow(
        _score_task(sent), "y_true long, y_pred long, n long, nll double")
    out = parts.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"), F.sum("nll").alias("nll")) \
        .orderBy("y_true", "y_pred").collect()
    sent.destroy()
    return out


def _save(spark: SparkSession, model: SoftmaxModel, path: str, epoch: int) -> None:
    row = (model.classes, len(model.weights), model.weights.astype("<f8").tobytes(), model.bias.astype("<f8").tobytes())
    spark.createDataFrame([row], "classes array<string>, features long, weights binary, bias binary") \
        .coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/epoch={epoch}")


def load_epoch(spark: SparkSession, path: str, epoch: int) -> SoftmaxModel:
    """The model after an epoch of the run that was stored under ``path``."""
    r = spark.read.parquet(f"{path.rstrip('/')}/epoch={epoch}").first()
    bias = np.frombuffer(bytes(r["bias"]), "<f8").copy()
    return SoftmaxModel(list(r["classes"]), np.frombuffer(bytes(r["weights"]), "<f8").reshape(-1, len(bias)).copy(), bias)


def predict_classes(model: SoftmaxModel, df: DataFrame, text: str = "sentence", keep: Sequence[str] = ("row_id",)) -> DataFrame:
    """keep..., label (the predicted class name), probabilities (array, in the order of the model's classes)."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for indices, weights in batches:
            for rows in _slices(indices):
                index, first = _lists(indices[rows])
                p = sent.value.probabilities(index, first, _lists(weights[rows])[0])
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1) * p.shape[1], pa.int32()), pa.array(p.ravel()))

    features = len(model.weights)
    out = text_vectors(df, text, features, keep).withColumn("probabilities", probabilities("indices", "weights"))
    best = F.array_position("probabilities", F.array_max("probabilities")).cast("int")
    return out.select(*keep, F.element_at(F.array(*[F.lit(c) for c in model.classes]), best).alias("label"), "probabilities")
