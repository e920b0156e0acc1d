"""Benchmark decontamination: a BM25 index of the test items, queried by every passage of the training documents.

The index holds, per word, its items with their BM25 weights, and the largest weight in every block of items.  A
passage is scored only where the block maxima of its words (as in block-max WAND) allow a hit; what remains gets exact
scores.  Hits are verified by five-word shingles of the whole item or of both its halves (question, answer).

Word statistics (items, document frequencies, mean and greatest length) are counted by Spark over all items.  Items go to
the tasks in portions of at most about ``INDEX_BYTES`` of text, one after another; as all portions share the statistics,
the matches do not depend on the portions.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections import Counter
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, once, text_of, written
from .pieces import PieceCache, Words, held, ragged, slices

#: Text bytes of the items in one index; a larger test set is queried in several portions.
INDEX_BYTES = 16 << 20
ITEM_BLOCK = 2
#: Bounds (passages x blocks of items) that are computed at a time.
BOUNDS = 1 << 20
K1, B = 1.2, 0.75
MATCHES = "array<struct<item_id:long,score:double,question_overlap:double,answer_overlap:double>>"
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words_of(text: str) -> list[str]:
    """Lower-cased words between white space, without punctuation at their ends; words of punctuation are left out."""
    return [w for w in (_EDGE.sub("", p) for p in text.lower().split()) if w]


def _shingles(tokens: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit code of every ``size`` consecutive tokens."""
    if len(tokens) < size:
        return np.empty(0, np.uint64)
    n = len(tokens) - size + 1
    code = np.zeros(n, dtype=np.uint64)
    for i in range(size):
        code = (code ^ tokens[i:i + n].astype(np.uint64)) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code


@dataclass(frozen=True)
class Statistics:
    """Of all items with words: their number, mean and greatest length, and the document frequency of (some) words."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]

    @staticmethod
    def of(parsed: list[tuple[int, list[str]]]) -> Statistics:
        sizes = [len(ws) for _, ws in parsed if ws]
        return Statistics(len(sizes), sum(sizes) / max(1, len(sizes)), max(sizes, default=0),
                          dict(Counter(w for _, ws in parsed for w in set(ws))))


class ItemIndex:
    """BM25 postings of (item_id, text or words) with item blocks; ``share`` of an item's score against itself is its
    threshold.  ``statistics`` are those of all items, of which these may be a portion."""

    def __init__(self, items: list[tuple], share: float, shingle: int, overlap: float, statistics: Statistics | None = None):
        parsed = [(i, words_of(t) if isinstance(t, str) else t) for i, t in items]
        parsed = sorted((x for x in parsed if x[1]), key=lambda x: (len(x[1]), x[0] is None, x[0] or 0))
        stats = statistics or Statistics.of(parsed)
        self.ids = [i for i, _ in parsed]
        self.overlap = overlap
        # in word order, in which scores are added up
        self.terms = {w: i for i, w in enumerate(sorted({w for _, ws in parsed for w in ws}))}
        tokens = [np.array([self.terms[w] for w in ws], dtype=np.int64) for _, ws in parsed]
        n, self.n_blocks = len(parsed), -(-len(parsed) // ITEM_BLOCK)
        length = np.array([len(t) for t in tokens], dtype=np.float64)
        term, item, tf = [], [], []
        for i, t in enumerate(tokens):
            u, c = np.unique(t, return_counts=True)
            term.append(u), item.append(np.full(len(u), i)), tf.append(c)
        term, item, tf = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (term, item, tf))
        df = np.array([stats.df[w] for w in self.terms])
        idf = np.log1p((stats.items - df + 0.5) / (df + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[item] / stats.mean)) if n else np.empty(0)
        order = np.lexsort((item, term))
        self.item, self.weight = item[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.threshold = share * np.bincount(item[order], self.weight, n)
        # block maxima, as postings of blocks
        key, inverse = np.unique(term * max(1, self.n_blocks) + item // ITEM_BLOCK, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, inverse, weight)
        self.block, self.block_max = key % max(1, self.n_blocks), top
        self.block_first = np.searchsorted(key // max(1, self.n_blocks), np.arange(len(self.terms) + 1))
        self.block_threshold = np.array([self.threshold[i:i + ITEM_BLOCK].min() for i in range(0, n, ITEM_BLOCK)])
        #: Passages are two strides long, so that every item lies whole in one.
        self.stride = max(32, stats.longest)
        half = [max(1, len(t) // 2) for t in tokens]
        self.parts = [tuple((min(shingle, len(p)), np.unique(_shingles(p, min(shingle, len(p)))))
                            for p in ((t, t[:h], t[h:]) if len(t) >= 2 * shingle else (t, t, t)))
                      for t, h in zip(tokens, half)]
        self.cache = PieceCache(self._tokens)
        self.codes = {w: array("i", [i]).tobytes() for w, i in self.terms.items()}

    def _tokens(self, pieces: list[str]) -> list[bytes]:
        """The terms of each piece between spaces (-1: a word that no item has)."""
        other, out = array("i", [-1]).tobytes(), []
        for p in pieces:
            low = p.lower()
            code = self.codes.get(low)  # a term has no punctuation around it: the piece is that word
            if code is None:
                code = other if low.isalnum() else array("i", [self.terms.get(w, -1) for w in words_of(p)]).tobytes()
            out.append(code)
        return out

    @staticmethod
    def _expand(first, rows):
        """Positions first[r] .. first[r + 1] for every r in rows, and which entry of rows they belong to."""
        size = first[rows + 1] - first[rows]
        owner = np.repeat(np.arange(len(rows)), size)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        return first[rows][owner] + inside, owner

    def match(self, texts: pa.Array) -> list[list[dict]]:
        """The verified items of every text."""
        out = [[] for _ in range(len(texts))]
        if not self.ids or not len(texts):
            return out
        words = Words(pc.replace_substring(texts, "\n", " "))
        term, size = ragged(self.cache.values(words.distinct), words.index, "i4")
        count = words.sums(size)
        first = np.cumsum(count) - count
        tokens = [term[a:a + n] for a, n in zip(first.tolist(), count.tolist())]
        strides = np.maximum(1, -(-count // self.stride))
        seg_first = np.append(0, np.cumsum(strides))  # strides of a document are numbered in a row
        at = np.arange(len(term)) - np.repeat(first, count)
        seg = np.repeat(seg_first[:-1], count) + at // self.stride
        known = term >= 0
        vocab = len(self.terms)
        pairs = np.unique(seg[known] * vocab + term[known])
        seg, term = pairs // vocab, pairs % vocab
        n_seg = int(seg_first[-1])
        doc_of = np.repeat(np.arange(len(out)), strides)
        # a passage: stride s and the next one of its document
        follows = np.append(doc_of[1:] == doc_of[:-1], False)
        at = np.searchsorted(seg, np.arange(n_seg + 1))
        step = max(1, BOUNDS // self.n_blocks)
        for a in range(0, n_seg, step):
            b = min(a + step, n_seg)
            # block maxima of a stride's words, then of both strides: no less than what the passage can reach
            pos, entry = self._expand(self.block_first, term[at[a]:at[min(b + 1, n_seg)]])
            cell = (seg[at[a]:at[min(b + 1, n_seg)]][entry] - a) * self.n_blocks + self.block[pos]
            bound = np.bincount(cell, self.block_max[pos], (b - a + 1) * self.n_blocks).reshape(-1, self.n_blocks)
            reach = bound[:-1] + np.where(follows[a:b, None], bound[1:], 0.0)
            able = reach * (1 + 1e-9) >= self.block_threshold
            some = np.flatnonzero(able.any(axis=1))
            for group in np.array_split(some, max(1, len(some) // 2000)):
                self._score(a + group, able[group], term, at, follows, doc_of, seg_first, tokens, out)
        for found in out:
            found.sort(key=lambda m: (-m["score"], m["item_id"] is None, m["item_id"] or 0))
        return out

    def _score(self, passages, able, term, at, follows, doc_of, seg_first, tokens, out):
        """Exact scores of the passages with the items of the blocks that they are ``able`` to reach."""
        if not len(passages):
            return
        last = passages + 1 + follows[passages]
        size = at[last] - at[passages]
        owner = np.repeat(np.arange(len(passages)), size)
        where = at[passages][owner] + np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        key = np.unique(owner * len(self.terms) + term[where])
        owner, words = key // len(self.terms), key % len(self.terms)
        # the same bound without the words that both strides have
        pos, entry = self._expand(self.block_first, words)
        cell = owner[entry] * self.n_blocks + self.block[pos]
        bound = np.bincount(cell, self.block_max[pos], len(passages) * self.n_blocks).reshape(-1, self.n_blocks)
        able = able & (bound * (1 + 1e-9) >= self.block_threshold)
        alive = able.any(axis=1)[owner]
        owner, words = owner[alive], words[alive]
        pos, entry = self._expand(self.first, words)
        item = self.item[pos]
        ok = able[owner[entry], item // ITEM_BLOCK]
        pos, entry, item = pos[ok], entry[ok], item[ok]
        hit, inverse = np.unique(owner[entry] * len(self.ids) + item, return_inverse=True)
        score = np.bincount(inverse, self.weight[pos], len(hit))
        good = score >= self.threshold[hit % len(self.ids)]
        codes_of: dict[tuple, np.ndarray] = {}  # (passage, size): its shingles
        for h, s in zip(hit[good].tolist(), score[good].tolist()):
            passage, i = int(passages[h // len(self.ids)]), h % len(self.ids)
            doc = int(doc_of[passage])
            start = (passage - int(seg_first[doc])) * self.stride
            window = tokens[doc][start:start + 2 * self.stride]
            shares = []
            for size, codes in self.parts[i]:
                if (passage, size) not in codes_of:
                    codes_of[passage, size] = _shingles(window, size)
                shares.append(float(np.isin(codes, codes_of[passage, size]).mean()))
            whole, *halves = shares
            # a changed word weighs twice as much in its half as in the item
            if whole >= self.overlap or min(halves) >= self.overlap:
                self._note(out[doc], self.ids[i], s, *halves)

    @staticmethod
    def _note(found, item_id, score, question, answer):
        for m in found:
            if m["item_id"] == item_id:
                m["score"] = max(m["score"], score)
                m["question_overlap"] = max(m["question_overlap"], question)
                m["answer_overlap"] = max(m["answer_overlap"], answer)
                return
        found.append({"item_id": item_id, "score": score, "question_overlap": question, "answer_overlap": answer})


def _parsed(items: DataFrame) -> DataFrame:
    """item_id, words of the distinct items with words."""
    @F.arrow_udf("array<string>")
    def words(texts: pa.Array) -> pa.Array:
        return pa.array([words_of(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    rows = items.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()
    return rows.select("item_id", once(words)("text").alias("words")).where(F.size("words") > 0)


def _portions(items: DataFrame):
    """(items, statistics) of every portion; the statistics are of all items, for the words of the portion."""
    parsed = written(_parsed(items), "items")
    size = F.expr("aggregate(words, 16L, (s, w) -> s + octet_length(w) + 8)")
    total = parsed.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("words")).alias("mean"),
                       F.max(F.size("words")).alias("longest"), F.sum(size).alias("bytes")).first()
    if not total["n"]:
        return
    df = written(parsed.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count(), "item-words")
    n = -(-total["bytes"] // INDEX_BYTES)
    for k in range(n):
        part = parsed.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(n)) == k) if n > 1 else parsed
        own = df.join(part.select(F.explode("words").alias("word")).distinct(), "word", "left_semi") if n > 1 else df
        rows = [(r["item_id"], r["words"]) for r in part.collect()]
        if rows:
            yield rows, Statistics(total["n"], total["mean"], total["longest"], {r["word"]: r["count"] for r in own.collect()})
    for table in (parsed, df):
        forget(table)


def _match_columns(text, items: DataFrame, share: float, shingle: int, overlap: float):
    """For each portion of the items, the column of its matches in each text: an array of (item_id, score,
    question_overlap, answer_overlap), best first."""
    for rows, statistics in _portions(items):
        yield _matches(text, items.sparkSession.sparkContext.broadcast((rows, share, shingle, overlap, statistics)))


def _index_of(name: str, portion) -> ItemIndex:
    """The index of this worker; ``name`` tells broadcasts apart."""
    return held(("items", name), lambda: ItemIndex(*portion.value))


def _matches(text, portion):
    name = uuid.uuid4().hex

    @F.arrow_udf(MATCHES)
    def matches(texts: pa.Array) -> pa.Array:
        index = _index_of(name, portion)
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()),
                                   ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]))
        return pa.array([m for part in slices(texts.fill_null("")) for m in index.match(part)], kind)
    return once(matches)(text)


def contamination_report(docs: DataFrame, items: DataFrame, share: float = 0.5, shingle: int = 5,
                         overlap: float = 0.8) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: a row for each test item in each contaminated row.

    An item is retrieved for a passage when its BM25 score reaches ``share`` of the item's score against itself, and
    counts when at least ``overlap`` of the shingles of the whole item, or of each of its halves (reported as question
    and answer), stand in the passage; halves of items of under two shingles are the whole item.  Of several passages of
    a text the greatest score and overlaps are reported.  Null and empty texts and items match nothing; equal items are
    indexed once, items with one id and different texts each; rows of ``docs`` are judged each by itself, whatever their
    ids; an empty table on either side gives no rows."""
    found = []
    for column in _match_columns(text_of(), items, share, shingle, overlap):
        found.append(written(docs.select("doc_id", F.inline(column)), "contamination"))
    if not found:
        return docs.select("doc_id", F.inline(F.from_json(F.lit("[]"), MATCHES)))
    return reduce(DataFrame.unionByName, found)


def drop_contaminated(docs: DataFrame, items: DataFrame, share: float = 0.5, shingle: int = 5,
                      overlap: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no test item, by the rule of :func:`contamination_report`.

    Each portion of the items judges what the ones before left."""
    left = None
    for column in _match_columns(text_of(), items, share, shingle, overlap):
        if left is not None:
            docs, old = written(left, "uncontaminated"), docs
            if hasattr(old, "written_path"):
                forget(old)
        left = docs.withColumn("__llm_found", column).where(F.size("__llm_found") == 0).drop("__llm_found")
    return docs if left is None else left
