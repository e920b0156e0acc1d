"""One training run in epochs: against plain numpy, its log, its stored weights."""
import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from lexiframe.operators import trainlog, training as T

FEATURES = 512
TEXTS = ["sunny and warm weather", "le temps est beau", "warm sunny day", "beau et chaud", "", None, "rain rain rain",
         "pluie et vent", "windy weather today", "vent et soleil", "a a a b", "il fait chaud"]
LABELS = ["en", "fr", "en", "fr", "en", "fr", "en", "fr", "en", "fr", "xx", "fr"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, t, y, "clash", 0) for i, (t, y) in enumerate(zip(TEXTS, LABELS))],
                                 "row_id long, sentence string, label string, indices string, batch int")


def plain_vectors():
    x = np.zeros((len(TEXTS), FEATURES))
    for i, t in enumerate(TEXTS):
        for w in (t or "").lower().split():
            x[i, int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % FEATURES] += 1
    x = np.log1p(x)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def plain_run(batches, epochs, lr, seed, clip, decay):
    """Dense AdamW with the same batches; (weights, bias) and mean loss after every epoch."""
    x, classes = plain_vectors(), sorted(set(LABELS))
    y = np.array([classes.index(v) for v in LABELS])
    order = sorted(range(len(y)), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))
    batch = np.zeros(len(y), int)
    batch[order] = np.arange(len(y)) * batches // len(y)
    w = np.zeros((FEATURES + 1, len(classes)))
    m, v, step, out = np.zeros_like(w), np.zeros_like(w), 0, []
    x1 = np.hstack([x, np.ones((len(y), 1))])
    for epoch in range(1, epochs + 1):
        loss = 0.0
        for b in T.batch_order(batches, epoch, seed):
            own = batch == b
            z = np.exp(x1[own] @ w)
            p = z / z.sum(axis=1, keepdims=True)
            loss -= np.log(p[np.arange(own.sum()), y[own]]).sum()
            p[np.arange(own.sum()), y[own]] -= 1
            g = x1[own].T @ p / own.sum()
            if clip is not None:
                g = g * min(1.0, clip / (np.sqrt((g * g).sum()) + 1e-6))
            rate = lr * (1 - step / (epochs * batches))
            step += 1
            w *= 1 - rate * decay
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w = w - rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        out.append((w[:-1].copy(), w[-1].copy(), loss / len(y)))
    return out


def test_one_full_batch_is_one_plain_step(spark, rows):
    run = T.train_epochs(rows, rows, epochs=1, lr=0.1, features=FEATURES, clip=None)
    (w, b, loss), = plain_run(1, 1, 0.1, 42, None, 0.0)
    assert np.abs(run.model.weights - w).max() < 1e-9 and np.abs(run.model.bias - b).max() < 1e-9
    assert abs(run.log.where("loss is not null").first()["loss"] - loss) < 1e-9


@pytest.mark.parametrize("batches,seed", [(4, 42), (5, 7)])
def test_epochs_of_batches_equal_plain_adamw(spark, rows, batches, seed):
    run = T.train_epochs(rows.repartition(3), rows, epochs=3, lr=0.05, batches=batches, seed=seed, features=FEATURES,
                         weight_decay=0.1, clip=0.5)
    want = plain_run(batches, 3, 0.05, seed, 0.5, 0.1)
    for epoch, (w, b, loss) in enumerate(want, 1):
        kept = T.load_epoch(spark, run.path, epoch)
        assert np.abs(kept.weights - w).max() < 1e-8 and np.abs(kept.bias - b).max() < 1e-8
    losses = [r["loss"] for r in run.log.where("loss is not null").orderBy("step").collect()]
    assert np.allclose(losses, [x[2] for x in want], atol=1e-9)
    best = T.load_epoch(spark, run.path, run.best_epoch)
    assert (best.weights == run.model.weights).all() and best.classes == ["en", "fr", "xx"]


def test_log_confusion_and_prediction(spark, rows):
    run = T.train_epochs(rows, rows, epochs=4, lr=0.3, batch_size=6, features=FEATURES)
    flat = trainlog.flatten_log(run.log, id_cols=["run", "log_pos"])
    assert flat.count() == 8 and "eval_f1" in flat.columns
    curves = trainlog.training_curves(run.log).orderBy("epoch").collect()
    assert [r["epoch"] for r in curves] == [1, 2, 3, 4] and curves[-1]["train_loss"] < curves[0]["train_loss"]
    assert [r["step"] for r in run.log.where("loss is not null").orderBy("step").collect()] == [2, 4, 6, 8]
    f1 = [(r["eval_f1"], -r["epoch"]) for r in run.log.where("eval_f1 is not null").collect()]
    assert run.best_epoch == -max(f1)[1]
    assert {r["s"] for r in run.confusion.groupBy("epoch").agg({"n": "sum"}).withColumnRenamed("sum(n)", "s").collect()} == {12}
    got = T.predict_classes(run.model, rows, keep=("row_id", "batch")).collect()
    x = plain_vectors()
    z = np.exp(x @ run.model.weights + run.model.bias)
    p = z / z.sum(axis=1, keepdims=True)
    for r in got:
        assert np.allclose(r["probabilities"], p[r["row_id"]], atol=1e-12)
        assert r["label"] == run.model.classes[int(p[r["row_id"]].argmax())]


def test_a_step_reads_its_batch_only(spark, rows):
    vectors = T.text_vectors(T._coded(rows, ["en", "fr", "xx"], "label"), features=FEATURES, keep=["row_id", "y"])
    stored = T._store(T.batches_of(vectors, "row_id", 4, len(TEXTS), 42), "batches", "batch")
    assert sorted(r["count"] for r in stored.groupBy("batch").count().collect()) == [3, 3, 3, 3]
    plan = stored.where("batch = 2")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(batch" in plan


def test_bad_labels_and_no_rows(spark, rows):
    with pytest.raises(ValueError):
        T.train_epochs(rows.limit(0), rows, epochs=1, features=FEATURES)
    with pytest.raises(ValueError):
        T.train_epochs(rows.selectExpr("row_id", "sentence", "nullif(label, 'xx') AS label"), rows, epochs=1, features=FEATURES)
    with pytest.raises(Exception, match="unseen label"):
        T.train_epochs(rows.where("label <> 'xx'"), rows, epochs=1, features=FEATURES)


def hashed_lists(rows, words):
    index = np.random.default_rng(rows).integers(0, FEATURES, rows * words)
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * words, pa.int32()), pa.array(index, pa.int32()))


def labelled_batch(hashed):
    vectors = T._unit_vector(hashed)
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(hashed)) % 3), *vectors.flatten()], ["y", "indices", "weights"])


def tasks():
    weights = np.random.default_rng(7).normal(size=(FEATURES, 3))
    sent = SimpleNamespace(value=T.SoftmaxModel(["en", "fr", "xx"], weights, np.zeros(3)))
    return T._gradient_task(sent), T._score_task(sent)


def test_memory_of_a_task_does_not_grow_with_its_batches(monkeypatch):
    monkeypatch.setattr(T, "SLICE", 1 << 14, raising=False)

    def peak(task, batch):
        tracemalloc.start()
        for _ in task(iter([batch])):
            pass
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    small, large = hashed_lists(400, 100), hashed_lists(8000, 100)
    for task in tasks():
        assert peak(task, labelled_batch(large)) < 2 * peak(task, labelled_batch(small))
    assert peak(T._unit_vectors, large) < 2 * peak(T._unit_vectors, small)


def test_slices_give_what_whole_batches_give(monkeypatch):
    hashed = pa.array([[3, 3, 5], [], list(range(40)), [7], [], [1, 2] * 9, [8, 8]], pa.list_(pa.int32()))
    batch = labelled_batch(hashed)
    want = [T._unit_vector(hashed).to_pylist(), *[list(task(iter([batch])))[0].to_pydict() for task in tasks()]]
    monkeypatch.setattr(T, "SLICE", 6)
    sizes = [r.stop - r.start for r in T._slices(hashed)]
    assert sum(sizes) == len(hashed) and len(sizes) > 3
    assert list(T._slices(hashed[:0])) == [] and [r.start for r in T._slices(hashed[2:])][0] == 0
    got = [r for part in T._unit_vectors(iter([hashed[:2], hashed[2:]])) for r in part.to_pylist()]
    assert got == want[0]
    for task, whole in zip(tasks(), want[1:]):
        parts = list(task(iter([batch])))[0].to_pydict()
        assert parts.keys() == whole.keys()
        assert all(np.allclose(parts[k], whole[k], atol=1e-12) for k in whole)


def test_rows_of_many_slices_through_spark(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    texts = [long, "rain", long, "", None, long, long, "rain rain", long]
    df = spark.createDataFrame(list(enumerate(texts)), "row_id long, sentence string").coalesce(1)
    size = 1 << 20
    found = {r["row_id"]: r for r in T.text_vectors(df, features=size, keep=["row_id"]).collect()}
    assert [len(found[i]["indices"]) > 90_000 for i in range(len(texts))] == [t == long for t in texts]
    assert sum(len(r["indices"]) for r in found.values()) > T.SLICE
    weights = np.random.default_rng(1).normal(size=(size, 2))
    model = T.SoftmaxModel(["a", "b"], weights, np.zeros(2))
    for r in T.predict_classes(model, df).collect():
        z = np.array(found[r["row_id"]]["weights"]) @ weights[found[r["row_id"]]["indices"]]
        p = np.exp(z - z.max())
        assert np.allclose(r["probabilities"], p / p.sum(), atol=1e-9) and r["label"] == "ab"[int(p.argmax())]
