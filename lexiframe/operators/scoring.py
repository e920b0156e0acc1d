"""Batch scoring with a user's model: loaded once per worker, fed batch by batch, padded to the longest row of a batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ``tokenize(sentence) -> sequence of ids``, ``forward(input_ids, attention_mask) -> logits (rows x classes)``.
Model = tuple[Callable[[str], Sequence[int]], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def padded_batch(rows: Sequence[Sequence[int]], max_length: int | None = None, pad_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """``input_ids`` and ``attention_mask`` of a batch: rows cut to ``max_length`` and padded to the longest one (one
    column at least)."""
    rows = [r[:max_length] for r in rows]
    width = max([1, *map(len, rows)])
    ids, mask = np.full((len(rows), width), pad_id, np.int64), np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        ids[i, :len(r)], mask[i, :len(r)] = r, 1
    return ids, mask


def logits_column(sentence: str | Column, load: Callable[[], Model], batch_size: int = 64, max_length: int | None = 128,
                  pad_id: int = 0) -> Column:
    """array<double> of the class scores of each sentence (a null one is empty).

    ``load`` runs once per Python worker and gives the model; its tokenizer and forward pass then see ``batch_size``
    sentences at a time, so memory is bounded by the longest batch."""
    def make_predict():
        tokenize, forward = load()

        def predict(sentences: np.ndarray) -> np.ndarray:
            # sentences of a batch: an array of texts
            ids, mask = padded_batch([list(tokenize(s)) for s in sentences.ravel().tolist()], max_length, pad_id)
            return np.asarray(forward(ids, mask), np.float64)
        return predict

    text = F.col(sentence) if isinstance(sentence, str) else sentence
    udf = predict_batch_udf(make_predict, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)
    return udf(F.coalesce(text, F.lit("")))


def with_logits(df: DataFrame, load: Callable[[], Model], sentence: str = "sentence", out: str = "logits", **options) -> DataFrame:
    """``df`` with the class scores of :func:`logits_column`; ``model.score_logits`` makes labels and probabilities of them."""
    return df.withColumn(out, logits_column(sentence, load, **options))
