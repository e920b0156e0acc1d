"""Rollout from rows and in blocks: equal to numpy and to the cell forms, whatever the block."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiframe.operators import attention as A
from lexiframe.operators import attention_blocks as B
from lexiframe.sources import tables


def tensors(sizes, layers=3, heads=2, seed=0):
    rng = np.random.default_rng(seed)
    out = {}
    for i, s in enumerate(sizes):
        w = rng.random((layers, heads, s, s))
        out[i] = w / w.sum(axis=-1, keepdims=True)
    return out


def rows_of(spark, att):
    rows = [(i, layer, head, q, [float(x) for x in w[layer, head, q]])
            for i, w in att.items() for layer in range(w.shape[0]) for head in range(w.shape[1]) for q in range(w.shape[2])]
    return spark.createDataFrame(rows, "sample_id long, layer int, head int, q int, weights array<double>").repartition(5)


def plain(w, residual=True):
    if residual:
        w = w + np.eye(w.shape[-1])
        w = w / w.sum(axis=-1, keepdims=True)
    j = w.mean(axis=1)
    v = j[-1][0]
    for m in j[-2::-1]:
        v = v @ m
    return v


@pytest.mark.parametrize("block", [1, 4, 7, 256])
def test_blocks_rows_and_cells_equal_numpy(spark, block):
    att = tensors([1, 3, 8, 20, 33])
    rows = rows_of(spark, att)
    cells = rows.select("sample_id", "layer", "head", "q", F.posexplode("weights").alias("k", "weight"))
    joint = A.joint_rows(rows)
    results = [B.rollout_blocks(joint, block), A.rollout(rows)]
    if block == 4:
        results += [A.rollout(cells), A.rollout(cells, method="join", n_layers=3), A.rollout(cells, method="blocks")]
    for got in results:
        got = {(r["sample_id"], r["k"]): r["score"] for r in got.collect()}
        for i, w in att.items():
            assert np.allclose([got.pop((i, k)) for k in range(w.shape[-1])], plain(w), atol=1e-12)
        assert not got


def test_without_residual_one_layer_and_no_rows(spark):
    att = tensors([5, 6], layers=1)
    rows = rows_of(spark, att)
    for got in (A.rollout(rows, add_residual=False, method="blocks"), A.rollout(rows, layers=1, add_residual=False)):
        for i, w in att.items():
            scores = [r["score"] for r in got.where(F.col("sample_id") == i).orderBy("k").collect()]
            assert np.allclose(scores, plain(w, False), atol=1e-12)
    assert B.rollout_blocks(A.joint_rows(rows.limit(0))).count() == 0


def test_rows_of_unequal_length_raise(spark):
    bad = spark.createDataFrame([(0, 0, 0, 0, [0.5, 0.5]), (0, 0, 1, 0, [1.0])],
                                "sample_id long, layer int, head int, q int, weights array<double>")
    with pytest.raises(Exception, match="not dense"):
        A.joint_rows(bad).collect()


def test_a_long_sample_stays_in_blocks(spark):
    s = 1500
    tokens = spark.range(s).select(F.lit(7).cast("long").alias("sample_id"), F.col("id").cast("int").alias("pos"),
                                   F.concat(F.lit("t"), F.col("id")).alias("token"))
    rows = tables.synthetic_attention_rows(tokens, layers=2, heads=1)
    blocks = B.attention_blocks(A.joint_rows(rows), 128)
    assert blocks.agg(F.max(F.size("cells"))).first()[0] == 128 * 128
    got = {r["k"]: r["score"] for r in B.rollout_blocks(A.joint_rows(rows), 128).collect()}
    w = np.zeros((2, 1, s, s))
    for r in rows.collect():
        w[r["layer"], r["head"], r["q"]] = r["weights"]
    assert np.allclose([got[k] for k in range(s)], plain(w), atol=1e-12)


def test_samples_are_dealt_by_their_cells(spark):
    tokens = spark.range(300 * 60).select((F.col("id") % 300).alias("sample_id"), F.floor(F.col("id") / 300).cast("int").alias("pos"),
                                          F.lit("x").alias("token"))
    rows = tables.synthetic_attention_rows(tokens)
    assert rows.rdd.getNumPartitions() == -(-300 * 60 * 60 * 6 // tables.PARTITION_CELLS)
