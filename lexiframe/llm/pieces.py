"""Cutting texts at spaces where no token can span the cut, and bounded caches of what the pieces give.

Natural text repeats its words, so tasks tokenize each distinct piece once while the cache holds it; the cache is
emptied when it is full, which bounds memory and changes no result.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces in one generation of a cache.
CACHE_PIECES = 200_000
#: Text bytes that are worked on at a time.
SLICE_BYTES = 4 << 20
#: Longer pieces are not kept.
CACHE_CHARS = 64

#: Unicode White_Space.
WHITE = "\t-\r \x85\xa0  -     　"


#: Matches where a space follows other white space: there a cut before the space is not safe.
IRREGULAR = f"[{WHITE}] "
_SAFE_CUT = re.compile(f"(?<=[^{WHITE}])(?= )")


def space_pieces(text: str) -> list[str]:
    """Pieces of any text cut before spaces that follow a character which is no white space.

    Every piece but the first begins with a space that is left out."""
    first, *rest = _SAFE_CUT.split(text)
    return [first, *(p[1:] for p in rest)]


def slices(column: pa.Array, size: int = SLICE_BYTES):
    """Slices of a string column of about ``size`` bytes (a longer text is one of its own)."""
    step = max(1, int(len(column) * size / max(1, column.nbytes)))
    for at in range(0, len(column), step):
        yield column.slice(at, step)


class Words:
    """The words of a column of texts between ASCII spaces, each distinct one once.

    distinct: list of str; index: which of them each word is; bounds: the words of text i are
    index[bounds[i]:bounds[i + 1]]."""

    def __init__(self, texts: pa.Array, separator: str = " "):
        lists = pc.split_pattern(texts, separator)
        values = lists.flatten().dictionary_encode()
        self.distinct = values.dictionary.to_pylist()
        self.index = values.indices.to_numpy(zero_copy_only=False)
        offsets = lists.offsets.to_numpy()
        self.bounds = offsets - offsets[0]

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum over the words of each text of a value per word."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def ragged(parts: list[bytes], index: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The concatenation of parts[i] for i in index, as numbers of ``kind``, and the length of each."""
    width = np.dtype(kind).itemsize
    size = np.fromiter(map(len, parts), np.int64, len(parts)) // width
    flat = np.frombuffer(b"".join(parts), dtype=kind)
    start = np.cumsum(size) - size
    n = size[index]
    end = np.cumsum(n)
    where = np.repeat(start[index] - (end - n), n)
    where += np.arange(len(where))
    return flat[where], n


#: What this Python worker keeps between tasks: the state of the operator that it ran last, and no other's.
_held: dict = {}


def held(name, build):
    """The state called ``name``, built when the worker does not hold it; what it held before is let go."""
    if name not in _held:
        _held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _held[name] = build()
    return _held[name]


class PieceCache:
    """piece -> value in two generations: what the last ``CACHE_PIECES`` distinct pieces did not use is forgotten.
    ``fill(pieces)`` computes the values of unknown pieces in one call."""

    def __init__(self, fill):
        self.fill, self.young, self.old = fill, {}, {}

    def values(self, pieces: list[str]) -> list:
        """The value of every one of distinct ``pieces``."""
        out = list(map(self.young.get, pieces))
        missing = [i for i, v in enumerate(out) if v is None]
        if not missing:
            return out
        unknown = []
        for i in missing:
            v = out[i] = self.old.get(pieces[i])
            if v is None:
                unknown.append(i)
        if unknown:
            for i, v in zip(unknown, self.fill([pieces[i] for i in unknown])):
                out[i] = v
        for i in missing:
            if len(pieces[i]) <= CACHE_CHARS:
                self.young[pieces[i]] = out[i]
        if len(self.young) > CACHE_PIECES:
            self.young, self.old = {}, self.young
        return out
