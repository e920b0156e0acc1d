"""Sub-token merge (G3), rollout against numpy, the figure golden (FIXTURES §4),
training-log flattening (G4), file sources and sinks (G6), model round trip,
streaming scoring."""
import glob
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import attention as A
from lexiframe.operators import model as M
from lexiframe.operators import trainlog
from lexiframe.sources import files

G3 = [("[CLS]", .1), ("stack", .2), ("##ing", .3), ("the", .4), ("##", .05), ("re", .1), ("##fact", .1),
      ("##or", .1), ("[SEP]", .2)]


def test_merge_subwords_golden(spark):
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(G3)], "sample_id long, pos int, token string, score double")
    got = [(r["word"], round(r["score"], 6)) for r in A.merge_subwords(df).orderBy("word_id").collect()]
    assert got == [("[CLS]", .1), ("stacking", .5), ("the", .45), ("refactor", .3), ("[SEP]", .2)]


def test_leading_piece_and_empty_word(spark):
    toks = [("##x", 1.0), ("", 2.0), ("##ab", 3.0), ("c", 4.0)]
    df = spark.createDataFrame([(1, i, t, s) for i, (t, s) in enumerate(toks)], "sample_id long, pos int, token string, score double")
    got = [(r["word"], r["score"]) for r in A.merge_subwords(df).orderBy("word_id").collect()]
    # reference loop: "x" opens its own word; "" + "ab" merge to "ab" with 2 + 3
    assert got == [("x", 1.0), ("ab", 5.0), ("c", 4.0)]


def _random_attention(spark, rng, samples=3, L=3, H=2, S=6):
    rows, mats = [], {}
    for sid in range(samples):
        a = rng.random((L, H, S, S))
        a /= a.sum(-1, keepdims=True)
        mats[sid] = a
        for l in range(L):
            for h in range(H):
                for q in range(S):
                    for k in range(S):
                        rows.append((sid, l, h, q, k, float(a[l, h, q, k])))
    df = spark.createDataFrame(rows, "sample_id long, layer int, head int, q int, k int, weight double")
    return df, mats


@pytest.mark.parametrize("method", ["arrays", "join"])
def test_rollout_matches_numpy(spark, method):
    rng = np.random.default_rng(5)
    df, mats = _random_attention(spark, rng)
    got = {(r["sample_id"], r["k"]): r["score"] for r in A.rollout(df, method=method, n_layers=3).collect()}
    first = {(r["sample_id"], r["k"]): r["score"] for r in A.rollout(df, layers=1, method=method).collect()}
    for sid, a in mats.items():
        S = a.shape[-1]
        j = (a + np.eye(S)) / (a + np.eye(S)).sum(-1, keepdims=True)
        j = j.mean(1)
        prod = j[0]
        for layer in range(1, j.shape[0]):
            prod = j[layer] @ prod
        assert np.allclose([got[(sid, k)] for k in range(S)], prod[0], atol=1e-12)
        assert abs(sum(got[(sid, k)] for k in range(S)) - 1) < 1e-12
        assert np.allclose([first[(sid, k)] for k in range(S)], j[0][0], atol=1e-12)


def test_aggregate_attention_modes(spark):
    rng = np.random.default_rng(6)
    df, mats = _random_attention(spark, rng, samples=1)
    a = mats[0]
    got = {(r["q"], r["k"]): r["weight"] for r in A.mean_attention(df).collect()}
    assert np.allclose([[got[(q, k)] for k in range(6)] for q in range(6)], a.mean(0).mean(0))
    got = {(r["q"], r["k"]): r["weight"] for r in A.mean_attention(df, at={"layer": 2, "head": 1}).collect()}
    assert np.allclose([[got[(q, k)] for k in range(6)] for q in range(6)], a[2, 1])
    assert A.mean_attention(df, over=("layer",)).count() == 2 * 36


FIGURE = [("my", 203), ("task", 253), ("was", 233), ("to", 116), ("find", 248), ("the", 0), ("best", 227),
          ("approach", 246), ("to", 91), ("refactor", 49), ("the", 55), ("software", 238), ("stack", 255),
          ("[SEP]", 109)]


def test_highlight_reproduces_figure(spark):
    df = spark.createDataFrame([(0, i, w, float(255 - c)) for i, (w, c) in enumerate(FIGURE)],
                               "sample_id long, word_id int, word string, score double")
    html = A.highlight_html(df).first()["html"]
    want = "<p>" + "".join(f'<span style="background:rgb(0,0,{c});color:white"> {w} </span>' for w, c in FIGURE) + "</p>"
    assert html == want


def test_flatten_log_golden(spark, tmpdir_path):
    state = {"log_history": [{"step": 1, "loss": .5, "epoch": 1}, {"step": 1, "eval_loss": .4, "epoch": 1,
                                                                     "note": "x", "flag": True}, {"epoch": 2}]}
    path = os.path.join(tmpdir_path, "trainer_state.json")
    json.dump(state, open(path, "w"))
    recs = files.read_trainer_log(spark, path)
    flat = trainlog.flatten_log(recs)
    assert flat.columns == ["step", "eval_loss", "flag", "loss"]
    assert flat.count() == 2
    kept = trainlog.flatten_log(recs, keep=["loss", "zzz"])
    assert kept.columns == ["step", "loss", "zzz"]
    assert [r["zzz"] for r in kept.collect()] == [None, None]
    assert trainlog.export_row_count(flat).first()["n_rows"] == 2


def test_csv_round_trip_quoting(spark, tmpdir_path):
    rows = [("he said \"hi\", ok\nnew", "a,b"), ("plain", "Task")]
    df = spark.createDataFrame(rows, "sentence string, label string").coalesce(1)
    out = os.path.join(tmpdir_path, "csv")
    files.write_csv(df, out)
    text = open(glob.glob(out + "/part-*.csv")[0]).read()
    assert '"he said ""hi"", ok\nnew","a,b"' in text
    back = files.read_sentences_csv(spark, out)
    assert sorted((r["sentence"], r["label"]) for r in back.collect()) == sorted(rows)
    with pytest.raises(ValueError):
        files.require_columns(df.select("sentence"))


def test_text_lines_and_inline(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "in.txt")
    open(p, "w", encoding="utf-8").write("  first line \n\n second\x0bthird  \r\nlast")
    got = [r["sentence"] for r in files.read_text_lines(spark, p).orderBy("line_id", "piece").collect()]
    assert got == [l.strip() for l in open(p, encoding="utf-8", newline="").read().splitlines() if l.strip()]
    inline = files.inline_sentences(spark, [" keep me ", ""])
    assert [r["sentence"] for r in inline.orderBy("row_id").collect()] == [" keep me ", ""]
    with pytest.raises(ValueError):
        files.inline_sentences(spark, [])


def test_jsonl_and_html_writers(spark, tmpdir_path):
    df = spark.createDataFrame([("é", None, "<p>x</p>")], "sentence string, label string, html string")
    files.write_jsonl(df.select("sentence", "label"), os.path.join(tmpdir_path, "j"))
    line = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(tmpdir_path + "/j/part-*.json"))).strip()
    assert json.loads(line) == {"sentence": "é", "label": None} and "é" in line
    files.write_html(df, os.path.join(tmpdir_path, "h"))
    assert "".join(open(f).read() for f in sorted(glob.glob(tmpdir_path + "/h/part-*.txt"))).strip() == "<p>x</p>"


@pytest.fixture(scope="module")
def toy_texts(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"the weather is sunny and warm number {i}", "en"))
        rows.append((100 + i, f"le temps est beau et chaud numéro {i}", "fr"))
    return spark.createDataFrame(rows, "row_id long, sentence string, label string")


def test_classifier_fit_predict_save_load(spark, toy_texts, tmpdir_path):
    m = M.fit_classifier(toy_texts, max_iter=20)
    assert M.class_names(m) == ["en", "fr"]
    p = M.predict(m, toy_texts.withColumnRenamed("label", "y"), keep=["y"])
    acc = p.where(F.col("label") == F.col("y")).count()
    assert acc / toy_texts.count() > 0.95
    path = os.path.join(tmpdir_path, "best_model")
    M.save_model(m, path)
    m2 = M.load_model(path)
    new = files.inline_sentences(spark, ["sunny weather", "beau temps"])
    got = [r["label"] for r in M.predict(m2, new).orderBy("row_id").collect()]
    assert got == ["en", "fr"]
    probs = M.predict(m2, new).select("prob_LABEL_0", "prob_LABEL_1").collect()
    assert all(abs(a + b - 1) < 1e-9 for a, b in probs)
    best, log = M.train_and_select(toy_texts, toy_texts, iters=(1, 5), path=path)
    assert log.count() == 4
    curves = trainlog.training_curves(log).orderBy("epoch").collect()
    assert [r["epoch"] for r in curves] == [1, 2] and all(r["train_loss"] > 0 and r["eval_loss"] > 0 for r in curves)
    again = M.predict(M.load_model(path), toy_texts.withColumnRenamed("label", "y"), keep=["y"])
    assert again.where(F.col("label") == F.col("y")).count() == toy_texts.count()
    assert M.evaluate_candidates(toy_texts, toy_texts, iters=(1, 5)).count() == 2


def test_encode_texts_fixed_and_longest(spark):
    vocab = spark.createDataFrame([("a", 1000), ("b", 1001)], "token string, id int")
    df = spark.createDataFrame([(1, "A b c"), (2, ""), (3, "a a a a a a")], "row_id long, text string")
    fixed = {r["row_id"]: r for r in M.encode_texts(df, "text", vocab, max_length=5).collect()}
    assert fixed[1]["input_ids"] == [101, 1000, 1001, 100, 102] and fixed[1]["attention_mask"] == [1] * 5
    assert fixed[2]["input_ids"] == [101, 102, 0, 0, 0] and fixed[2]["attention_mask"] == [1, 1, 0, 0, 0]
    assert fixed[3]["input_ids"] == [101, 1000, 1000, 1000, 102] and fixed[3]["n_tokens"] == 6
    longest = {r["row_id"]: r for r in M.encode_texts(df, "text", vocab, max_length=64, padding="longest").collect()}
    assert len(longest[2]["input_ids"]) == 8 and longest[3]["attention_mask"] == [1] * 8


def test_map_batches(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "é")], "row_id long, text string")
    out = M.map_batches(df, lambda pdf: pdf.assign(n=pdf["text"].str.len())[["row_id", "n"]], "row_id long, n long")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 2), (2, 1)]


def test_streaming_scoring(spark, toy_texts, tmpdir_path):
    from lexiframe.streaming import sentence_stream, write_available_now
    m = M.fit_classifier(toy_texts, max_iter=20)
    src = os.path.join(tmpdir_path, "incoming")
    os.makedirs(src)
    open(os.path.join(src, "a.txt"), "w").write("sunny and warm\n\n  beau et chaud  \n")
    stream = sentence_stream(spark, src).withColumn("row_id", F.lit(0).cast("long"))
    scored = M.predict(m, stream, "row_id", "sentence")
    sink = os.path.join(tmpdir_path, "scored")
    write_available_now(scored, sink, os.path.join(tmpdir_path, "ckpt"))
    got = {r["sentence"]: r["label"] for r in spark.read.parquet(sink).collect()}
    assert got == {"sunny and warm": "en", "beau et chaud": "fr"}
