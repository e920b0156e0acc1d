"""Array-valued class scores: softmax, argmax, label decoding, wide columns.

Higher-order functions (``transform``/``aggregate``) keep the work in the JVM.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once (a one-element transform)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def softmax(logits) -> Column:
    """Numerically stable softmax over an array<double>; maximum and total are computed once."""
    arr = _c(logits).cast("array<double>")
    shifted = bind(F.array_max(arr), lambda top: F.transform(arr, lambda x: F.exp(x - top)))
    total = lambda e: F.aggregate(e, F.lit(0.0).cast("double"), lambda acc, x: acc + x)
    return bind(shifted, lambda e: bind(total(e), lambda t: F.transform(e, lambda x: x / t)))


def argmax(values) -> Column:
    """0-based index of the maximum; the first one on ties."""
    arr = _c(values)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def label_code_names(n_classes: int, prefix: str = "LABEL_") -> list[str]:
    return [f"{prefix}{i}" for i in range(n_classes)]


def decode_label(code, mapping: Mapping[str, str], prefix: str = "LABEL_") -> Column:
    """code -> ``LABEL_i`` -> mapped name; an unknown key raises, as a dict lookup does."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    key = F.concat(F.lit(prefix), _c(code).cast("string"))
    found = m[key]
    return F.when(found.isNotNull(), found).otherwise(
        F.raise_error(F.concat(F.lit("unknown label key: "), key)))


def vector_columns(vec, names: Sequence[str], prefix: str = "prob_", prob_names: str = "code",
                   mapping: Mapping[str, str] | None = None) -> list[Column]:
    """One double column per class: ``prob_LABEL_0`` ... (names as given);
    ``prob_names='mapped'`` names them by ``mapping`` (``LABEL_i`` -> class name)."""
    if prob_names not in ("code", "mapped"):
        raise ValueError("prob_names is 'code' or 'mapped'")
    v = _c(vec)
    shown = [(mapping or {})[n] for n in names] if prob_names == "mapped" else names
    return [v[i].cast("double").alias(f"{prefix}{name}") for i, name in enumerate(shown)]
