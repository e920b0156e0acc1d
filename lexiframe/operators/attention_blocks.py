"""Attention rollout of long sequences: the maps as blocks of positions.

A layer's joint map is cut into blocks of ``block`` x ``block`` positions; the importance vector is cut the same way.  A
product of a layer multiplies each vector block with the blocks of its positions and adds up the parts by key, so a task
holds single blocks, whatever the length of a sample, and a position pair is shuffled as one double of an array.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

BLOCK = 256


def attention_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """sample_id, layer, qb, kb, rows, cells: the joint rows (sample_id, layer, q, row) as blocks; ``cells`` are those of
    the block's query positions, ``rows`` of them, one after another in ascending order."""
    parts = F.transform(F.sequence(F.lit(0), F.ceil(F.size("row") / block).cast("int") - 1),
                        lambda b: F.struct(b.alias("kb"), F.slice("row", b * block + 1, F.lit(block)).alias("part")))
    cut = rows.select("sample_id", "layer", "q", F.explode(parts).alias("p")) \
        .select("sample_id", "layer", "q", F.floor(F.col("q") / block).cast("int").alias("qb"), "p.*")
    grouped = cut.groupBy("sample_id", "layer", "qb", "kb").agg(F.array_sort(F.collect_list(F.struct("q", "part"))).alias("__r"))
    return grouped.select("sample_id", "layer", "qb", "kb", F.size("__r").alias("rows"),
                          F.flatten(F.transform("__r", lambda x: x["part"])).alias("cells"))


def _products(vectors: pa.Array, rows: pa.Array, cells: pa.Array) -> pa.Array:
    """vector x block for every row of a batch."""
    out = [np.asarray(v) @ np.asarray(m).reshape(n, -1) for v, n, m in zip(
        (v.values.to_numpy() for v in vectors), rows.to_pylist(), (m.values.to_numpy() for m in cells))]
    first = np.cumsum([0, *map(len, out)])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(np.concatenate(out) if out else np.empty(0)))


def rollout_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """sample_id, k, score: row 0 of the product of all layers of the joint ``rows``, the last layer first.

    The blocks are stored once; a step joins the vector blocks with those of one layer and adds the products by
    (sample, block of keys).  Samples may differ in length, and must have the same layers."""
    top = rows.agg(F.max("layer")).first()[0]
    if top is None:
        return rows.select("sample_id", F.lit(0).alias("k"), F.lit(0.0).alias("score")).limit(0)
    first = rows.where((F.col("layer") == top) & (F.col("q") == 0))
    vector = first.select("sample_id", F.posexplode(F.transform(
        F.sequence(F.lit(0), F.ceil(F.size("row") / block).cast("int") - 1),
        lambda b: F.slice("row", b * block + 1, F.lit(block)))).alias("qb", "v"))
    blocks = reliable_checkpoint(attention_blocks(rows.where(F.col("layer") < top), block)) if top else None
    product = F.arrow_udf(_products, "array<double>")
    for layer in range(top - 1, -1, -1):
        parts = vector.join(blocks.where(F.col("layer") == layer), ["sample_id", "qb"]) \
            .select("sample_id", "kb", "qb", product("v", "rows", "cells").alias("part"))
        # at most S / block parts a key, added in order of their positions
        sums = parts.groupBy("sample_id", "kb").agg(F.array_sort(F.collect_list(F.struct("qb", "part"))).alias("__p"))
        total = F.aggregate(F.slice("__p", 2, F.size("__p")), F.element_at("__p", 1)["part"],
                            lambda acc, x: F.zip_with(acc, x["part"], lambda a, b: a + b))
        vector = sums.select("sample_id", F.col("kb").alias("qb"), total.alias("v"))
    cells = vector.select("sample_id", "qb", F.posexplode("v").alias("i", "score"))
    return cells.select("sample_id", (F.col("qb") * block + F.col("i")).cast("int").alias("k"), "score")
