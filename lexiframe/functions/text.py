"""Column -> Column text functions with exact Python string semantics.

All of them are built-in Spark expressions (JVM side, whole-stage codegen);
none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import HTML_ESCAPES, NOT_WS_CLASS, SUBWORD_PREFIX, WS_CLASS, WS_RUN, LINE_BREAKS


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def split_labels(label, sep: str = ",", trim_labels: bool = False) -> Column:
    """``x.split(sep)``: literal separator, empties kept, no trimming by default."""
    parts = F.split(_c(label), _regex_literal(sep), -1)
    if trim_labels:
        parts = F.transform(parts, lambda x: strip_ws(x))
    return parts


def _regex_literal(s: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}" else ch for ch in s)


def word_count(text) -> Column:
    """``len(x.split())``: number of runs of non-whitespace (Unicode, as Python).

    Split on whitespace runs; only the first and the last piece can be empty
    (leading / trailing whitespace), so they are subtracted.  A positive class is
    used on purpose: the JVM evaluates a negated Unicode class far more slowly.
    """
    parts = F.split(_c(text), WS_RUN, -1)
    n = F.size(parts)
    first_empty = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last_empty = F.when((n > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (n - first_empty - last_empty).cast("long")


def words(text) -> Column:
    """``x.split()`` as an array (leading/trailing whitespace ignored)."""
    return F.filter(F.split(_c(text), WS_RUN, -1), lambda x: x != F.lit(""))


def strip_ws(text) -> Column:
    """``x.strip()`` with Python's whitespace set (``trim`` only removes blanks)."""
    return F.regexp_replace(_c(text), r"\A" + WS_RUN + r"|" + WS_RUN + r"\z", "")


def split_lines(text) -> Column:
    """``x.splitlines()`` boundaries (``\\r\\n``, ``\\n``, VT, FF, ``\\r``, 0x1C-0x1E, NEL, U+2028/9)."""
    return F.split(_c(text), LINE_BREAKS, -1)


def strip_subword_prefix(token) -> Column:
    """``tok[2:]`` when the token starts with ``##``, else the token."""
    t = _c(token)
    return F.when(t.startswith(SUBWORD_PREFIX), F.substring(t, len(SUBWORD_PREFIX) + 1, 1 << 30)).otherwise(t)


def html_escape(text) -> Column:
    """``html.escape(s, quote=True)``; ``&`` is replaced first."""
    out = _c(text)
    for raw, entity in HTML_ESCAPES:
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def contains_text(text, needle: str) -> Column:
    """Python ``needle in text`` on the raw string (substring, not list membership)."""
    return F.instr(_c(text), needle) > 0


def letter_count(text, letter: str) -> Column:
    """Occurrences of one character: ``len(t) - len(t.replace(c, ''))``."""
    t = _c(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(letter), F.lit("")))).cast("long")


__all__ = [
    "split_labels", "word_count", "words", "strip_ws", "split_lines", "strip_subword_prefix",
    "html_escape", "contains_text", "letter_count", "WS_CLASS",
]
