"""Profiling, trimming and unions on the hand-checked sentences G1 (FIXTURES §2)."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lexiframe.functions import word_count
from lexiframe.operators import outliers, profile, stats

G1 = [(0, "I led the team", "Action"), (1, "we had an outage", "Situation,Task"), (2, "I led the team", "Action"),
      (3, "sales rose  ten percent", "Result"), (4, "my goal was growth", "Task, Action"), (5, " a b ", "Task,Task")]


@pytest.fixture(scope="module")
def g1(spark):
    df = spark.createDataFrame(G1, "row_id long, sentence string, label string")
    return df.withColumn("n_words", word_count("sentence"))


def test_words_mean_std_global_z(g1):
    assert [r[0] for r in g1.orderBy("row_id").select("n_words").collect()] == [4, 4, 4, 4, 4, 2]
    z = {r["row_id"]: r["z"] for r in stats.zscore(g1, "n_words").collect()}
    assert round(z[0], 6) == 0.447214 and round(z[5], 6) == -2.236068
    m = stats.group_moments(g1, "n_words").first()
    assert round(m["mean"], 6) == 3.666667 and round(m["std_pop"], 6) == 0.745356


def test_label_counts_first_seen(g1):
    rows = profile.label_counts(g1, "label", "row_id").orderBy("seen_order").collect()
    assert [(r["label"], r["n"]) for r in rows] == [("Action", 2), ("Situation", 1), ("Task", 4), ("Result", 1),
                                                   (" Action", 1)]


def test_cooccurrence(g1):
    got = {(r["label_a"], r["label_b"]): r["n"] for r in profile.cooccurrence(g1, "label").collect()}
    want = {("Action", "Action"): 2, ("Situation", "Situation"): 1, ("Situation", "Task"): 1,
            ("Task", "Situation"): 1, ("Task", "Task"): 6, ("Result", "Result"): 1, ("Task", " Action"): 1,
            (" Action", "Task"): 1, (" Action", " Action"): 1}
    assert got == want
    names = sorted({a for a, _ in want})
    dense = profile.cooccurrence_matrix(profile.cooccurrence(g1, "label"), names)
    assert dense.count() == 5 and len(dense.columns) == 6
    rows = profile.dense_cooccurrence(profile.cooccurrence(g1, "label")).collect()
    assert {(r["label_a"], r["label_b"]): r["n"] for r in rows} == {(a, b): want.get((a, b), 0) for a in names for b in names}
    items = profile.explode_labels(g1, "label").select("row_id", "label_item")
    assert {(r["label_a"], r["label_b"]): r["n"] for r in profile.cooccurrence_items(items).collect()} == want


def test_duplicates(g1):
    assert sorted(r["row_id"] for r in profile.duplicate_rows(g1, ["sentence"]).collect()) == [0, 2]
    rep = profile.duplicate_report(g1, ["sentence"]).first()
    assert (rep["n_dup_rows"], rep["n_dup_groups"]) == (2, 1)


def test_trimmed_union_literal(g1):
    e = profile.explode_labels(g1, "label")
    kept = outliers.trim_by_label(e, "label_item", "n_words", trim=("Situation", "Result", "Task"), keep=("Action",))
    rows = kept.collect()
    assert len(rows) == 6
    assert sorted(r["label_item"] for r in rows) == ["Action", "Action"] + ["Task"] * 4
    assert abs(np.mean([r["n_words"] for r in rows]) - 20 / 6) < 1e-12


def test_mixed_union(g1):
    out = outliers.union_mixed(g1, "label", "n_words", needle="Task")
    assert out.count() == 9
    assert outliers.union_mixed(g1, "label", "n_words", needle="Task", dedup=True).count() == 6


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(1)
    for vals in (rng.integers(1, 500, 300), np.array([7, 7, 7]), rng.normal(0, 1, 257)):
        df = spark.createDataFrame([(float(v),) for v in vals], "x double")
        got = [r["n"] for r in stats.histogram(df, "x", 20).orderBy("bin").collect()]
        want, _ = np.histogram(vals, bins=20)
        assert got == list(want)


def test_kde_matches_numpy(spark):
    rng = np.random.default_rng(2)
    vals = rng.integers(1, 60, 200).astype(float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = stats.kde(df, "x").orderBy("grid_idx").collect()
    n, sd = len(vals), vals.std(ddof=1)
    bw = sd * n ** -0.2
    grid = np.linspace(vals.min() - 3 * bw, vals.max() + 3 * bw, 200)
    dens = np.exp(-0.5 * ((grid[:, None] - vals[None, :]) / bw) ** 2).sum(1) / (n * bw * np.sqrt(2 * np.pi))
    assert np.allclose([r["x"] for r in got], grid, atol=1e-9)
    assert np.allclose([r["density"] for r in got], dens, rtol=1e-9, atol=1e-15)
    assert abs(np.trapezoid(dens, grid) - 1) < 1e-2


def test_box_stats_matches_matplotlib_rules(spark):
    vals = np.array([1, 2, 2, 3, 3, 3, 4, 4, 5, 40, -30], dtype=float)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    r = stats.box_stats(df, "x").first()
    q1, med, q3 = np.percentile(vals, [25, 50, 75])
    iqr = q3 - q1
    hi = vals[vals <= q3 + 1.5 * iqr].max()
    lo = vals[vals >= q1 - 1.5 * iqr].min()
    assert (r["q1"], r["med"], r["q3"], r["whislo"], r["whishi"]) == (q1, med, q3, lo, hi)
    assert r["n_fliers"] == int(((vals < lo) | (vals > hi)).sum())


def test_summary_matches_pandas(spark):
    pdf = pd.DataFrame({"a": [1.0, 2.0, 2.0, 9.5, None], "s": ["x", "y", "y", None, "z"], "k": [3, 1, 2, 5, 4]})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "a double, s string, k long")
    got = {r["col_name"]: r for r in profile.summary(df).collect()}
    d = pdf.describe(include="all")
    for c in ("a", "k"):
        for stat, key in (("mean", "mean"), ("std", "std"), ("min", "min_v"), ("25%", "p25"), ("50%", "p50"),
                          ("75%", "p75"), ("max", "max_v")):
            assert abs(got[c][key] - float(d.loc[stat, c])) < 1e-12
    assert (got["s"]["n"], got["s"]["n_unique"], got["s"]["top"], got["s"]["freq"]) == (4, 3, "y", 2)


def test_exact_quantiles_bucketed(spark):
    rng = np.random.default_rng(3)
    vals = rng.normal(100, 20, 5000)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = stats.exact_quantiles(df, "x", [0.25, 0.5, 0.75])
    want = np.percentile(vals, [25, 50, 75])
    assert np.allclose([got[0.25], got[0.5], got[0.75]], want, rtol=0, atol=1e-9)


def test_column_info_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (None, "a")], "a long, b string")
    info = profile.column_info(df).orderBy("col_pos").collect()
    assert [(r["col_name"], r["col_type"], r["non_null"]) for r in info] == [("a", "bigint", 1), ("b", "varchar", 1)]
    assert [r["n_null"] for r in profile.null_counts(df).orderBy("col_pos").collect()] == [1, 1]


def test_summary_timestamps_independent_of_session_zone(spark):
    import datetime as dt
    df = spark.createDataFrame([(dt.datetime(1970, 1, 2, 12, 0),), (dt.datetime(1970, 1, 4, 0, 0),)],
                               "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        got = []
        for tz in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", tz)
            r = profile.summary(df).first()
            got.append((r["min_v"], r["max_v"], r["mean"]))
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [(1.5, 3.0, 2.25)] * 3
