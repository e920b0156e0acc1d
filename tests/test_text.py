"""Column functions against Python string semantics (FIXTURES §2 G5-G8)."""
import string

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexiframe.functions import (html_escape, softmax, argmax, split_labels, split_lines, strip_subword_prefix,
                                 strip_ws, word_count)

ALPHABET = "ab \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff\u00e9"


def _col(spark, values, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("t"))).collect()]


def test_word_count_golden(spark):
    vals = ["", "  a b ", "a\u00a0b", "a\u200bb", "I led the team", "sales rose  ten percent", " a b "]
    assert _col(spark, vals, word_count) == [0, 2, 2, 1, 4, 4, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=8))
def test_word_count_strip_lines_property(spark, texts):
    assert _col(spark, texts, word_count) == [len(t.split()) for t in texts]
    assert _col(spark, texts, strip_ws) == [t.strip() for t in texts]
    got = _col(spark, texts, split_lines)
    for t, parts in zip(texts, got):
        assert [p for p in parts if p.strip()] == [line for line in t.splitlines() if line.strip()]


def test_split_labels_no_trim(spark):
    vals = ["a, b,", "", "Task,Task", "Task, Action"]
    assert _col(spark, vals, split_labels) == [v.split(",") for v in vals]
    assert _col(spark, vals, lambda c: split_labels(c, trim_labels=True)) == [
        [x.strip() for x in v.split(",")] for v in vals]


def test_html_escape_and_subword(spark):
    import html
    vals = ["a&<>\"'", "plain", "&amp;"]
    assert _col(spark, vals, html_escape) == [html.escape(v) for v in vals]
    assert _col(spark, ["##ing", "stack", "##", "#x"], strip_subword_prefix) == ["ing", "stack", "", "#x"]


def test_softmax_argmax_golden(spark):
    df = spark.createDataFrame([([2.0, 1.0, 0.0, 2.0],)], "l array<double>")
    r = df.select(softmax("l").alias("p"), argmax("l").alias("a")).first()
    assert [round(x, 6) for x in r["p"]] == [0.399486, 0.146963, 0.054065, 0.399486]
    assert r["a"] == 0
    assert abs(sum(r["p"]) - 1) < 1e-12
