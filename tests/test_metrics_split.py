"""Metrics golden G2, stratified split quotas and invariance."""
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import metrics, split
from lexiframe.sources import tables

from conftest import SF

G2_TRUE = ["Action", "Action", "Result", "Situation", "Task", "Task"]
G2_PRED = ["Action", "Result", "Result", "Situation", "Task", "Action"]


@pytest.fixture(scope="module")
def g2(spark):
    return spark.createDataFrame(list(zip(G2_TRUE, G2_PRED)), "y_true string, y_pred string")


def test_confusion_matrix(g2):
    m = {(r["y_true"], r["y_pred"]): r["n"] for r in metrics.confusion_matrix(g2).collect()}
    labels = ["Action", "Result", "Situation", "Task"]
    assert [[m[(a, b)] for b in labels] for a in labels] == [[1, 1, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [1, 0, 0, 1]]


def test_report_and_metrics(g2):
    rep = {r["label"]: r for r in metrics.report_with_overall(g2).collect()}
    assert [round(rep[k]["precision"], 6) for k in ("Action", "Result", "Situation", "Task")] == [.5, .5, 1, 1]
    assert [round(rep[k]["recall"], 6) for k in ("Action", "Result", "Situation", "Task")] == [.5, 1, 1, .5]
    assert [round(rep[k]["f1"], 6) for k in ("Action", "Result", "Situation", "Task")] == [.5, .666667, 1, .666667]
    assert rep["Overall"]["support"] == 6 and round(rep["Overall"]["precision"], 6) == .75
    e = metrics.evaluate(g2).first()
    assert round(e["accuracy"], 6) == .666667 and round(e["recall"], 6) == round(e["accuracy"], 6)
    assert round(e["f1"], 6) == .666667 and round(e["mcc"], 6) == .576923 and round(e["kappa"], 6) == .555556


def test_kappa_undefined_and_mcc_zero(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a")], "y_true string, y_pred string")
    e = metrics.evaluate(df).first()
    assert e["kappa"] is None and e["mcc"] == 0.0 and e["accuracy"] == 1.0


def test_quotas_largest_remainder(spark):
    def quotas(counts):
        rows = spark.createDataFrame([(k,) for k, n in counts.items() for _ in range(n)], "label string")
        return {r["label"]: r["quota"] for r in split.split_quotas(rows, "label").collect()}
    assert quotas({"de": 129, "en": 620, "es": 106, "fr": 145}) == {"de": 103, "en": 496, "es": 85, "fr": 116}
    with pytest.raises(ValueError):
        quotas({"a": 1, "b": 5})


def test_split_on_documents_exact_and_invariant(spark):
    docs = tables.load(spark, SF["0.01"], "documents")
    s = tables.single_label_sentences(docs)
    a = split.stratified_split(s, "label", "row_id")
    b = split.stratified_split(s.repartition(7), "label", "row_id")
    c = split.stratified_split(s.coalesce(1), "label", "row_id")
    ka = {r["row_id"]: r["split"] for r in a.collect()}
    assert ka == {r["row_id"]: r["split"] for r in b.collect()} == {r["row_id"]: r["split"] for r in c.collect()}
    assert len(ka) == 1000
    q = {(r["label"], r["split"]): r["n"] for r in a.groupBy("label", "split").count().withColumnRenamed(
        "count", "n").collect()}
    assert {k: q[(k, "train")] for k in ("de", "en", "es", "fr")} == {"de": 103, "en": 496, "es": 85, "fr": 116}


def test_sequence_number_matches_row_number(spark):
    from pyspark.sql import Window
    from lexiframe.operators.ranking import sequence_number
    ev = tables.load(spark, SF["0.01"], "events")
    ours = sequence_number(ev, ["user_id"], ["ts", "event_id"], out="rn", partitions=5)
    ref = ev.withColumn("rn2", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    j = ours.join(ref.select("event_id", "rn2"), "event_id")
    assert j.where(F.col("rn") != F.col("rn2")).count() == 0 and j.count() == ev.count()
