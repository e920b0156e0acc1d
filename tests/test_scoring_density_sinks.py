"""User models, densities from bins, observed writes, HTML files."""
import hashlib
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import model as M, scoring, stats, training
from lexiframe.sources import files, html_files, observed, paths


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_user_model_equals_the_reloaded_run_at_any_batch_size(spark, batch):
    texts = ["sunny warm day", "le temps est beau", "", None, "rain", "a b c d e f g", "beau temps " * 50] * 9
    rows = spark.createDataFrame([(i, t, "en" if i % 2 else "fr") for i, t in enumerate(texts)],
                                 "row_id long, sentence string, label string").repartition(3)
    run = training.train_epochs(rows, rows, epochs=2, lr=0.1, features=256)
    stored = training.load_epoch(spark, run.path, 2)
    weights, bias = stored.weights, stored.bias

    def load():
        def tokenize(sentence):
            return [int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256 + 1 for w in sentence.lower().split()]

        def forward(ids, mask):
            out = np.zeros((len(ids), weights.shape[1]))
            for i, (r, m) in enumerate(zip(ids, mask)):
                index, tf = np.unique(r[m == 1] - 1, return_counts=True)
                w = np.log1p(tf)
                out[i] = (w / max(1e-300, np.sqrt((w * w).sum()))) @ weights[index] + bias
            return out
        return tokenize, forward

    mine = scoring.with_logits(rows, load, batch_size=batch, max_length=None)
    got = {r["row_id"]: r for r in M.score_logits(mine, "logits", {"LABEL_0": "en", "LABEL_1": "fr"}).collect()}
    for r in training.predict_classes(stored, rows).collect():
        g = got[r["row_id"]]
        assert g["label"] == r["label"]
        assert np.allclose([g["prob_LABEL_0"], g["prob_LABEL_1"]], r["probabilities"], atol=1e-12)


def test_batches_are_padded_to_their_longest_row():
    ids, mask = scoring.padded_batch([[1, 2, 3], [], [4], [5] * 9], max_length=4, pad_id=9)
    assert ids.tolist() == [[1, 2, 3, 9], [9] * 4, [4, 9, 9, 9], [5] * 4]
    assert mask.tolist() == [[1, 1, 1, 0], [0] * 4, [1, 0, 0, 0], [1] * 4]
    assert scoring.padded_batch([[], []])[0].shape == (2, 1) and scoring.padded_batch([[7] * 300], None)[0].shape == (1, 300)


def test_the_model_is_loaded_once_per_worker(spark, tmp_path):
    def load():
        (tmp_path / f"load-{os.getpid()}-{os.urandom(4).hex()}").touch()
        return lambda s: [ord(c) for c in s], lambda ids, mask: np.stack([mask.sum(axis=1), 0 * mask.sum(axis=1)], axis=1)
    df = spark.range(400).select(F.lit("xy").alias("sentence")).coalesce(1)
    assert scoring.with_logits(df, load, batch_size=3) \
        .where(F.col("logits")[0] == 2).count() == 400
    workers = [f.name.split("-")[1] for f in tmp_path.iterdir()]
    assert workers and len(workers) == len(set(workers))


def test_binned_density_within_its_bound_of_the_plain_sum(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["n"] * 4000 + ["t"] * 2000 + ["c"] * 5 + [None] * 500,
                        "x": np.concatenate([rng.normal(size=4000), rng.standard_t(2, 2000) * 1e3, np.full(5, 3.0),
                                             rng.exponential(size=500)])})
    df = spark.createDataFrame(pdf).repartition(4)
    got = stats.kde_binned(df, "x", ["g"]).toPandas()
    assert set(got["g"].map(str)) == {"n", "t", "None"} and len(got) == 600
    for g, part in got.groupby("g", dropna=False):
        x = pdf.loc[pdf["g"].isna() if not isinstance(g, str) else pdf["g"] == g, "x"].to_numpy()
        bw = x.std(ddof=1) * len(x) ** -0.2
        part = part.sort_values("grid_idx")
        assert np.allclose(part["x"], np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 200))
        plain = np.exp(-0.5 * ((part["x"].to_numpy()[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * np.sqrt(2 * np.pi))
        assert np.abs(part["density"] - plain).max() <= (0.4 / (8 * 64 ** 2) + np.exp(-18) * 0.4) / bw
    whole = stats.kde_binned(df.where("g = 'n'"), "x").orderBy("grid_idx").collect()
    part = got[got["g"] == "n"].sort_values("grid_idx")
    assert np.allclose([r["density"] for r in whole], part["density"], atol=1e-12)
    assert stats.kde_binned(df.limit(0), "x", ["g"]).count() == 0


def test_observed_counts_equal_a_reread_and_scan_once(spark, tmp_path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, F.lit("x")).alias("a b"), F.lit(None).cast("double").alias("z"))
    out = str(tmp_path / "out")
    reads = spark.sparkContext.accumulator(0)

    def tick(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b
    counted = df.mapInArrow(tick, df.schema)
    got = {r["column"]: (r["n_rows"], r["n_null"]) for r in observed.write_observed(
        counted, lambda d: d.write.parquet(out), required=["id"]).collect()}
    back = spark.read.parquet(out)
    assert got == {c: (back.count(), back.where(F.col(f"`{c}`").isNull()).count()) for c in df.columns}
    assert reads.value == 1000
    with pytest.raises(ValueError):
        observed.write_observed(df, lambda d: None, required=["nope"])


def test_html_files_are_named_by_sample_and_repeated_tasks_leave_one(spark, tmp_path):
    out = str(tmp_path / "html")
    rows = [("1", "<p>é</p>"), ("a/b c+d", "x\n\ny"), ("2", None)]
    df = spark.createDataFrame(rows, "sample_id string, html string").repartition(2)
    html_files.write_html_files(df, out)
    names = sorted(os.listdir(out))
    assert [n for n in names if n.endswith(".html")] == ["sample-1.html", "sample-2.html", "sample-a%2Fb%20c%2Bd.html"]
    assert "_SUCCESS" in names and not [n for n in names if n.startswith(".") and not n.endswith(".crc")]
    back = {r["sample"]: r["html"] for r in html_files.read_html_files(spark, out).collect()}
    assert back.pop("2", "") == "" and back == dict(rows[:2])
    # the same task again, and a job that fails
    writer = html_files.HtmlWriter(out, "sample-")
    first, again = writer.write(iter([("9", "z")])), writer.write(iter([("9", "z")]))
    assert first.names == again.names and open(os.path.join(out, "sample-9.html")).read() == "z"
    writer.abort([first, None])
    assert not os.path.exists(os.path.join(out, "sample-9.html"))
    for bad in ([(None, "x")], [("1", "x"), ("1", "y")]):
        with pytest.raises(ValueError):
            writer.write(iter(bad))
    with pytest.raises(Exception):
        spark.dataSource.register(html_files.HtmlPerSample)
        df.write.format(html_files.FORMAT).mode("overwrite").save(out)


def test_paths_of_shared_folders(tmp_path):
    from pyarrow import fs
    for uri in (str(tmp_path), f"file:{tmp_path}", f"file://{tmp_path}"):
        found, path = paths.filesystem(uri)
        assert isinstance(found, fs.LocalFileSystem) and path == str(tmp_path)
    assert paths.arrow_uri("s3a://bucket/a b") == "s3://bucket/a b"
    assert paths.arrow_uri("wasbs://c@x.net/a") == "abfss://c@x.net/a" and paths.arrow_uri("gs://b/a") == "gs://b/a"
    with pytest.raises(Exception):
        paths.filesystem("nosuch://x/y")
