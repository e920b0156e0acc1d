"""Token counts by rank-synchronous array merging.

Pre-tokens of a batch are one flat array of byte symbols with the owner of each symbol.  In every round each pre-token
finds its lowest-ranked adjacent pair and all pre-tokens merge theirs at once; finished ones leave the arrays.  What
survives is counted.  The vocabulary file only gives the merge list, the pre-tokenizer and the special strings.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, text_of
from .pieces import IRREGULAR, PieceCache, Words, held, slices, space_pieces

NO_RANK = np.int32(np.iinfo(np.int32).max)


class PairTable:
    """(left symbol, right symbol) -> rank and merged symbol, by open addressing in flat arrays."""

    def __init__(self, left, right, merged):
        self.bits = max(10, int(np.ceil(np.log2(len(left) * 8 + 1))))
        size = 1 << self.bits
        self.key = np.full(size, -1, dtype=np.int64)
        self.rank = np.full(size, NO_RANK, dtype=np.int32)
        self.merged = np.zeros(size, dtype=np.int32)
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        for rank, (k, slot, to) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), merged)):
            while self.key[slot] not in (-1, k):
                slot = (slot + 1) & (size - 1)
            if self.key[slot] == -1:
                self.key[slot], self.rank[slot], self.merged[slot] = k, rank, to

    def _slot(self, keys):
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left, right):
        """rank (NO_RANK where there is no such merge) and merged symbol of every pair."""
        keys = (left.astype(np.int64) << 32) | right
        slot = self._slot(keys)
        rank = np.full(len(keys), NO_RANK, dtype=np.int32)
        merged = np.zeros(len(keys), dtype=np.int32)
        open_ = np.arange(len(keys))
        while len(open_):
            at = self.key[slot]
            hit = at == keys[open_]
            rank[open_[hit]] = self.rank[slot[hit]]
            merged[open_[hit]] = self.merged[slot[hit]]
            more = ~hit & (at != -1)
            open_, slot = open_[more], (slot[more] + 1) & (len(self.key) - 1)
        return rank, merged


def merge_counts(symbols: np.ndarray, lengths: np.ndarray, table: PairTable) -> np.ndarray:
    """Symbols that survive all merges, for each of the ragged sequences."""
    counts = np.zeros(len(lengths), dtype=np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    while len(symbols):
        last = np.empty(len(owner), dtype=bool)  # the last symbol of its sequence
        last[:-1] = owner[1:] != owner[:-1]
        last[-1] = True
        starts = np.flatnonzero(np.append(True, last[:-1]))
        rank = np.full(len(symbols), NO_RANK, dtype=np.int32)
        merged = np.zeros(len(symbols), dtype=np.int32)
        pairs = np.flatnonzero(~last)
        if len(pairs):
            rank[pairs], merged[pairs] = table.find(symbols[pairs], symbols[pairs + 1])
        best = np.minimum.reduceat(rank, starts)
        size = np.diff(np.append(starts, len(symbols)))
        done = best == NO_RANK
        counts[owner[starts[done]]] = size[done]
        each = np.repeat(best, size)
        alive = each != NO_RANK
        merge = alive & (rank == each)
        # of overlapping occurrences (a a a) every second one merges, from the left
        before = np.append(False, merge[:-1])
        if (merge & before).any():
            index = np.arange(len(merge))
            run = np.maximum.accumulate(np.where(merge & ~before, index, 0))
            merge &= (index - run) % 2 == 0
        symbols = np.where(merge, merged, symbols)
        stay = alive & ~np.append(False, merge[:-1])
        symbols, owner = symbols[stay], owner[stay]
    return counts


def byte_symbols() -> dict[str, int]:
    """Printable character -> byte of the byte-level alphabet: visible Latin-1 stands for itself, the rest from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class RankCounter:
    """Token counts of texts for a byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.table = PairTable([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges],
                               [vocab[a + b] for a, b in merges])
        self.symbol = np.zeros(512, dtype=np.int32)
        for char in byte_symbols():
            self.symbol[ord(char)] = vocab[char]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.pre = Tokenizer.from_file(path).pre_tokenizer
        self.words = PieceCache(self._count_words)
        self.inner, self.first = PieceCache(self._count_inner), PieceCache(self._count)

    def _count_words(self, words: list[str]) -> list[int]:
        """words: pre-tokens in the printable alphabet."""
        flat = self.symbol[np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")]
        return merge_counts(flat, np.array([len(w) for w in words]), self.table).tolist()

    def _pretoken_counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and tokens of every pre-token of ``text`` (a printable character is a byte)."""
        words = [w for w, _ in self.pre.pre_tokenize_str(text)]
        distinct = list(set(words))
        count = dict(zip(distinct, self.words.values(distinct)))
        return (np.fromiter(map(len, words), np.int64, len(words)),
                np.fromiter(map(count.__getitem__, words), np.int64, len(words)))

    def _count(self, texts: list[str]) -> list[int]:
        return [int(self._pretoken_counts(t)[1].sum()) for t in texts]

    def _count_inner(self, pieces: list[str]) -> list[int]:
        """Pieces that follow a space: joined again, pre-tokenized in one call and told apart by their bytes."""
        odd = [i for i, p in enumerate(pieces) if not p or p[-1].isspace()]
        plain = [i for i, p in enumerate(pieces) if p and not p[-1].isspace()]
        out = [0] * len(pieces)
        for i, n in zip(odd, self._count([" " + pieces[i] for i in odd])):
            out[i] = n
        if plain:
            joined = [" " + pieces[i] for i in plain]
            size, tokens = self._pretoken_counts("".join(joined))
            ends = np.cumsum([len(p.encode()) for p in joined])
            piece = np.searchsorted(ends, np.cumsum(size), side="left")
            for i, n in zip(plain, np.bincount(piece, tokens, len(plain)).astype(np.int64).tolist()):
                out[i] = n
        return out

    def _segments(self, text: str) -> tuple[int, list[str]]:
        """How many special strings the text holds, and the texts between them."""
        found, segments = 0, [text]
        for s in self.special:
            cut = [seg.split(s) for seg in segments]
            found += sum(len(c) - 1 for c in cut)
            segments = [seg for c in cut for seg in c]
        return found, [seg for seg in segments if seg]

    def _count_any(self, text: str) -> int:
        total, segments = self._segments(text)
        for segment in segments:
            head, *tail = space_pieces(segment)
            distinct = list(set(tail))
            count = dict(zip(distinct, self.inner.values(distinct)))
            total += self.first.values([head])[0] + sum(map(count.__getitem__, tail))
        return total

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text.  Texts with a special string or a space after other white space go one by one."""
        special = pc.match_substring_regex(texts, IRREGULAR)
        for s in self.special:
            special = pc.or_(special, pc.match_substring(texts, s))
        special = special.to_numpy(zero_copy_only=False)
        words = Words(texts)
        inner = np.array(self.inner.values(words.distinct), dtype=np.int64)[words.index]
        heads = words.index[words.bounds[:-1]]
        distinct, where = np.unique(heads, return_inverse=True)
        first = self.first.values([words.distinct[i] for i in distinct.tolist()])
        inner[words.bounds[:-1]] = np.array(first, dtype=np.int64)[where]
        out = words.sums(inner)
        for i in np.flatnonzero(special).tolist():
            out[i] = self._count_any(texts[i].as_py())
        return out


def counter_of(path: str) -> RankCounter:
    """The counter of this worker, with its caches."""
    return held(("token counts", path), lambda: RankCounter(path))


def token_count_column(text, vocabulary: str):
    """Tokens of each text for the vocabulary file at ``vocabulary`` (the same path on every executor)."""
    @F.arrow_udf("long")
    def counts(texts: pa.Array) -> pa.Array:
        counter = counter_of(vocabulary)
        found = [counter.count(part) for part in slices(texts.fill_null(""))]
        return pa.array(np.concatenate(found) if found else [], pa.int64())
    return once(counts)(text)


def token_report(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs``: whole texts, a null text as the empty one (0 tokens).

    Ids are passed through (null or repeated ones too); a special string inside a text is its one token, as the
    library has it; an empty table gives no rows."""
    text = text_of()
    return docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                       token_count_column(text, vocabulary).alias("n_tokens")) \
        .withColumn("over_limit", F.col("n_tokens") > limit)
