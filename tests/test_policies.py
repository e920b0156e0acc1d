"""Missing values, wide integers, outer joins and the promised parameters."""
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.functions import vectors
from lexiframe.operators import metrics, profile, ranking, stats, trainlog
from lexiframe.sources import files


def test_full_join_keeps_the_keys_of_both_sides(spark):
    a = spark.createDataFrame([(1, "x"), (None, "n")], "k long, a string")
    b = spark.createDataFrame([(2, "y"), (None, "m")], "k long, b string")
    got = {tuple(r) for r in ranking.join_on_keys(a, b, ["k"], "full").collect()}
    assert got == {(1, "x", None), (2, None, "y"), (None, "n", "m")}


def test_curves_with_more_eval_than_train_records(spark):
    rows = [("r", 1, 1, None, 0.9, 0.1), ("r", 1, 2, 0.5, None, None), ("r", 2, 3, None, 0.8, 0.2)]
    recs = spark.createDataFrame(rows, "run string, step long, log_pos long, loss double, eval_loss double, eval_accuracy double")
    got = {tuple(r) for r in trainlog.training_curves(recs).collect()}
    assert got == {("r", 1, 0.5, 0.9, 0.1), ("r", 2, None, 0.8, 0.2)}


def test_nan_is_missing_as_in_pandas(spark):
    values = [float("nan"), 1.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    want = pd.Series(values).describe()
    got = profile.summary(df).first()
    assert (got["n"], got["mean"], got["p75"], got["max_v"]) == (2, want["mean"], want["75%"], want["max"])
    assert abs(got["std"] - want["std"]) < 1e-12
    assert profile.null_counts(df).first()["n_null"] == 1 and profile.column_info(df).first()["non_null"] == 2


def test_summary_of_a_column_with_over_a_million_distinct_values(spark):
    df = spark.range(1_200_001).select((F.col("id") * 3).alias("v"), F.lit("same").alias("s"),
                                       F.col("id").cast("string").alias("u"))
    got = {r["col_name"]: r for r in profile.summary(df).collect()}
    assert [got["v"][c] for c in ("n", "min_v", "p25", "p50", "p75", "max_v")] == [
        1_200_001, 0.0, 900_000.0, 1_800_000.0, 2_700_000.0, 3_600_000.0]
    assert (got["s"]["top"], got["s"]["freq"], got["s"]["n_unique"]) == ("same", 1_200_001, 1)
    assert (got["u"]["top"], got["u"]["freq"], got["u"]["n_unique"]) == ("0", 1, 1_200_001)


def test_text_lines_have_ids_beyond_any_partition(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"first {i}\n\n second\x0bthird \n")
    got = files.read_text_lines(spark, str(tmp_path)).where("source like '%/1.txt'").orderBy("line_id", "piece").collect()
    assert [r["sentence"] for r in got] == ["first 1", "second", "third"]
    ids = spark.range(0, 2, 1, 1).select((F.lit(1074 * (1 << 33)) + F.col("id")).alias("line_id"))
    assert ids.count() == 2  # a partition number this high still fits a line id


def test_null_labels(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "row_id long, label string")
    with pytest.raises(Exception, match="null in one of"):
        profile.explode_labels(df).collect()
    assert profile.explode_labels(df, on_null="drop").count() == 2
    pred = spark.createDataFrame([("a", "b"), (None, "a")], "y_true string, y_pred string")
    got = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(pred).collect()}
    assert len(got) == 9 and got[None, "a"] == 1 and got["a", "b"] == 1 and sum(got.values()) == 2


def test_report_names_every_class_and_is_written(spark, tmp_path):
    pred = spark.createDataFrame([("a", "a"), ("b", "a")], "y_true string, y_pred string")
    rep = {r["label"]: r for r in metrics.report_with_overall(pred, labels=["a", "b", "c"]).collect()}
    assert rep["c"]["support"] == 0 and rep["c"]["f1"] == 0.0 and rep["Overall"]["support"] == 2
    metrics.write_report(pred, str(tmp_path / "out"), labels=["a", "b", "c"])
    back = {n: spark.read.option("header", True).csv(str(tmp_path / "out" / n)).count() for n in ("matrix", "classes", "scores")}
    assert back == {"matrix": 9, "classes": 4, "scores": 1}


def test_probability_names_and_softmax(spark):
    df = spark.createDataFrame([([0.1, 0.9], [1000.0, 1001.0])], "p array<double>, l array<double>")
    names = vectors.vector_columns("p", ["LABEL_0", "LABEL_1"], prob_names="mapped", mapping={"LABEL_0": "de", "LABEL_1": "en"})
    assert df.select(*names).columns == ["prob_de", "prob_en"]
    got = df.select(vectors.softmax("l").alias("s")).first()["s"]
    assert np.allclose(got, [1 / (1 + np.e), np.e / (1 + np.e)])


def test_inline_sentences_strip(spark):
    assert [r["sentence"] for r in files.inline_sentences(spark, [" a ", " "], strip=True).collect()] == ["a"]


def test_count_curve_is_density_times_rows_times_bin_width(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 9)], "v double")
    d = {r["grid_idx"]: r["density"] for r in stats.kde(df, "v").collect()}
    c = {r["grid_idx"]: r["density"] for r in stats.kde(df, "v", scale="count", bins=4).collect()}
    assert all(abs(c[i] - d[i] * 5 * 2.0) < 1e-12 for i in d)


def test_log_keys_of_text_are_no_metrics(spark, tmp_path):
    log = {"log_history": [{"step": 1, "loss": 0.5, "version": "0.5", "mixed": 1.5}, {"step": 2, "mixed": "n/a", "flag": True}]}
    (tmp_path / "state.json").write_text(json.dumps(log))
    recs = files.read_trainer_log(spark, str(tmp_path / "state.json"))
    assert sorted(trainlog.numeric_fields(recs, id_cols=["source"])) == ["flag", "loss", "mixed"]


def test_word_pieces_and_their_encoding(spark):
    from lexiframe.operators import model
    vocab = spark.createDataFrame([("un", 7), ("##aff", 8), ("##able", 9), ("##a", 10), ("a", 11)], "token string, id int")
    ws = spark.createDataFrame([(w,) for w in ("unaffable", "unx", "a", "aa", "y" * 200, "a")], "token string")
    pieces = model.word_pieces(ws, vocab)
    got = {r["token"]: r["pieces"] for r in pieces.collect()}
    assert got == {"unaffable": ["un", "##aff", "##able"], "unx": ["[UNK]"], "a": ["a"], "aa": ["a", "##a"], "y" * 200: ["[UNK]"]}
    df = spark.createDataFrame([(1, "A unaffable aa"), (2, ""), (3, "aa aa aa aa aa")], "row_id long, text string")
    enc = {r["row_id"]: r for r in model.encode_texts(df, "text", vocab, max_length=6, pieces=pieces).collect()}
    assert enc[1]["input_ids"] == [101, 11, 7, 8, 9, 102] and enc[1]["n_tokens"] == 3
    assert enc[2]["input_ids"] == [101, 102, 0, 0, 0, 0] and enc[3]["input_ids"] == [101, 11, 10, 11, 10, 102]
