"""Quantiles by selection, row numbers in file order, nested logs as VARIANT."""
import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import quantiles as Q, ranking, stats, trainlog
from lexiframe.sources import files, order

PROBS = [0, 0.25, 0.5, 0.753, 1]


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(0)
    n = 60_000
    pdf = pd.DataFrame({"slot": rng.choice(["a", "b", None, "c"], n, p=[.6, .2, .1, .1]), "x": rng.normal(size=n) * 1e6})
    pdf.loc[pdf["slot"] == "b", "x"] = rng.integers(0, 3, (pdf["slot"] == "b").sum())
    pdf.loc[pdf["slot"] == "c", "x"] = np.where(rng.random((pdf["slot"] == "c").sum()) < 0.9, 7.5, rng.normal(size=(pdf["slot"] == "c").sum()))
    pdf.loc[:20, "x"] = np.nan
    return pd.concat([pdf, pd.DataFrame({"slot": ["one", "none"], "x": [5.0, np.nan]})])


@pytest.mark.parametrize("leaf", [1 << 16, 400, 2])
def test_selection_equals_numpy(spark, skewed, leaf):
    df = spark.createDataFrame(skewed).repartition(5)
    got = {r["slot"]: list(r)[1:] for r in Q.quantiles(df, "x", PROBS, ["slot"], leaf=leaf).collect()}
    want = {k if isinstance(k, str) else None: np.quantile(part, PROBS)
            for k, part in skewed.dropna(subset=["x"]).groupby("slot", dropna=False)["x"]}
    assert got.keys() == want.keys()
    for k in want:
        assert np.allclose(got[k], want[k], rtol=1e-12, atol=0), k


def test_selection_without_keys_and_of_nothing(spark, skewed):
    df = spark.createDataFrame(skewed)
    assert np.allclose(list(Q.quantiles(df, "x", PROBS).first()), np.quantile(skewed["x"].dropna(), PROBS), rtol=1e-12)
    assert Q.quantiles(df.limit(0), "x", PROBS, ["slot"]).count() == 0
    assert stats.exact_quantiles(df.where("slot = 'none'"), "x", [0.5]) == {0.5: None}
    by_type = stats.grouped_quantiles(df.withColumn("i", F.when(~F.isnan("x"), F.col("x")).cast("long")), "i", [0.5], ["slot"])
    assert "percentile" in by_type._jdf.queryExecution().toString()


def test_small_frames_are_broadcast_and_large_ones_shuffled(spark):
    left = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    right = spark.createDataFrame([(0, "x"), (1, "y"), (None, "z")], "k long, v string")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()
    small = ranking.join_small(left, right, ["k"], "left")
    large = ranking.join_small(left, right, ["k"], "left", rows=2)
    assert "BroadcastHashJoin" in plan(small) and "hashpartitioning" not in plan(small)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect())) and small.count() == 1000


def test_lines_of_many_split_files_are_numbered_in_order(spark, tmp_path):
    want = []
    for i, n in enumerate([5, 0, 3000, 1, 700]):
        lines = [f"file {i} line {j} " + "x" * (j % 97) for j in range(n)]
        (tmp_path / f"part-{i}.txt").write_text("".join(x + "\n" for x in lines))
        want += [(f"part-{i}.txt", j, x) for j, x in enumerate(lines)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = order.numbered_scan(spark.read.text(str(tmp_path)), line="line", file="file").orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(os.path.basename(r["file"]), r["line"], r["value"]) for r in got] == want
    assert [r["row_id"] for r in got] == list(range(len(want)))
    assert files.read_text_lines(spark, str(tmp_path)).where("line_id = 5").first()["sentence"].startswith("file 2 line 0")


def test_csv_and_parquet_rows_are_numbered_in_order(spark, tmp_path):
    rows = [(i, f'say "{i}",\nok', "a,b") for i in range(300)]
    frames = [rows[:10], rows[10:11], rows[11:290], rows[290:]]
    for i, part in enumerate(frames):
        pd.DataFrame(part, columns=["row_id", "sentence", "label"]).drop(columns="row_id").to_csv(tmp_path / f"{i}.csv", index=False)
        pd.DataFrame(part, columns=["id", "sentence", "label"]).to_parquet(tmp_path / f"{i}.parquet")
    csv = files.read_sentences_csv(spark, str(tmp_path / "*.csv")).orderBy("row_id").collect()
    assert [tuple(r) for r in csv] == rows
    back = order.read_numbered_parquet(spark, [str(tmp_path / f"{i}.parquet") for i in (2, 0, 3, 1)], "n")
    assert sorted((r["n"], r["id"]) for r in back.collect()) == [(i, i) for i in range(300)]
    assert order.read_numbered_parquet(spark, str(tmp_path / "0.parquet")).where("row_id = 3").first()["id"] == 3


def test_logs_as_variant(spark, tmp_path):
    odd = [{"step": 1, "loss": .5, "epoch": 1}, {"step": 1, "eval_loss": .4, "note": "x", "flag": True, "it's": 3, "in": {"a": 1}},
           {"epoch": 2}, 5, None, {"step": 2, "loss": 1, "mix": 1, "n": None, "source": "s"}, {"step": 3, "loss": 1e-7, "mix": "a"}]
    (tmp_path / "a.json").write_text(json.dumps({"log_history": odd}))
    (tmp_path / "b.json").write_text(json.dumps({"other": 1}))
    (tmp_path / "c.json").write_text(json.dumps({"log_history": {"a": 1}}))
    recs = files.read_trainer_log(spark, str(tmp_path))
    assert recs.columns == ["source", "log_pos", "epoch", "eval_loss", "flag", "in", "it's", "loss", "mix", "note",
                            "record_source", "step"]
    rows = {r["log_pos"]: r for r in recs.collect()}
    assert set(rows) == {0, 1, 2, 5, 6}
    assert rows[1]["flag"] is True and rows[1]["in"] == '{"a":1}' and rows[1]["it's"] == 3 and rows[5]["mix"] == "1"
    assert (rows[0]["loss"], rows[5]["loss"], rows[6]["loss"]) == (0.5, 1.0, 1e-7)
    flat = trainlog.flatten_log(recs)
    assert flat.columns == ["step", "eval_loss", "flag", "it's", "loss", "mix"] and flat.count() == 4
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "d.json").write_text("{}")
    assert files.read_trainer_log(spark, str(tmp_path / "none")).columns == ["source", "log_pos"]


def test_long_runs_are_written_as_several_states(spark, tmp_path):
    records = spark.range(1, 2501).select(F.lit("r").alias("run"), F.col("id").alias("log_pos"),
                                          F.to_json(F.struct(F.col("id").alias("step"))).alias("json"))
    files.write_trainer_log(records, str(tmp_path / "log"))
    states = spark.read.text(str(tmp_path / "log"))
    assert states.count() == 3
    back = files.read_trainer_log(spark, str(tmp_path / "log"), lines=True)
    assert sorted(r["step"] for r in back.collect()) == list(range(1, 2501))
