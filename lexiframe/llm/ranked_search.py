"""Ranked lexical search: the best documents of the corpus for every item, by document FP-trees.

Documents are reduced to term vectors restricted to the terms of the items (term, tf), written once with each
document's length.  Counts over all of them (N, L, document frequencies) fix the weights.  Every task then puts its
documents into FP-trees: a document is its terms in descending document frequency, and documents that begin with the same
terms share a path.  A node keeps the largest tf of every term and the least m below it, which bounds the score of all
its documents; each item searches a tree depth first, best child first, and leaves out what can't reach its tenth best
score so far.  The best documents of all tasks are merged per item.

Items go to the tasks in blocks of at most about ``BLOCK_BYTES`` of text.  All counts are over all documents, so the
result does not depend on the blocks.
"""

from __future__ import annotations

import heapq
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, id_back, id_of, lower_ascii, once, text_of, written
from .pieces import Words, slices

#: Text bytes of the items in one block.
BLOCK_BYTES = 4 << 20
#: Documents and vector entries of one tree, documents of a leaf, terms by which a path can branch.
TREE_DOCS, TREE_ENTRIES, LEAF, DEPTH = 8192, 1 << 20, 32, 64
#: Partial results of this many groups of tasks are merged first.
MERGE_GROUPS = 64
#: What is no part of a term, by the contract; every other character is.
NO_TERM = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"

#: Bytes of UTF-8 text to bytes where terms are lower-cased and everything else is a space.
_BYTES = bytes(range(256)).translate(bytes.maketrans(
    (NO_TERM + UPPER).encode(), b" " * len(NO_TERM) + LOWER.encode()))


# ------------------------------------------------------------------------------------------------ term vectors

def terms_of(text: Column) -> Column:
    """The terms of a text, in order, repeats included."""
    return F.regexp_extract_all(lower_ascii(text), F.lit(TERM), F.lit(0))


def _spaced(texts: pa.Array) -> pa.Array:
    """The texts with every character that is no part of a term as a space, and A-Z lower-cased."""
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    if not len(texts) or data is None:
        return pa.array([""] * len(texts), pa.string())
    raw = memoryview(data)[int(bounds[0]):int(bounds[-1])].tobytes().translate(_BYTES)
    return pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(bounds - bounds[0]), pa.py_buffer(raw)])


def restricted_vectors(texts: pa.Array, vocabulary: dict[str, int]) -> tuple:
    """Number of terms of each text; owner, term id and tf of every term of the vocabulary in a text, sorted."""
    words = Words(_spaced(texts))
    term = np.fromiter((vocabulary.get(w, -1) for w in words.distinct), np.int64, len(words.distinct))[words.index]
    some = np.fromiter(map(bool, words.distinct), np.int64, len(words.distinct))[words.index]
    owner = np.repeat(np.arange(len(texts)), np.diff(words.bounds))
    size = max(1, len(vocabulary))
    key, tf = np.unique((owner * size + term)[term >= 0], return_counts=True)
    return words.sums(some), key // size, key % size, tf


VECTOR = "struct<n:long,terms:array<int>,tfs:array<int>>"


def _vector_column(text: Column, vocabulary) -> Column:
    """n, terms, tfs of each text; ``vocabulary`` is a broadcast term -> id."""
    @F.arrow_udf(VECTOR)
    def vectors(texts: pa.Array) -> pa.Array:
        parts = []
        for part in slices(texts.fill_null("")):
            n, owner, term, tf = restricted_vectors(part, vocabulary.value)
            ends = pa.array(np.searchsorted(owner, np.arange(len(part) + 1)), pa.int32())
            parts.append(pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (term, tf))],
                ["n", "terms", "tfs"]))
        kind = pa.struct([("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])
        return pa.concat_arrays(parts) if parts else pa.array([], kind)
    return once(vectors)(text)


# ------------------------------------------------------------------------------------------------ the tree

def part_score(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys starts."""
    return np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else \
        np.empty(0, np.int64)


class FPTree:
    """Documents of one batch: CSR vectors of (frequency rank of the term, tf), with ids and m.

    Nodes are contiguous ranges of the documents in path order.  Only nodes that are leaves, or hold at most three
    quarters of the documents of the last bounded node above, have bounds; the others have those of that node."""

    def __init__(self, did: np.ndarray, m: np.ndarray, owner: np.ndarray, rank: np.ndarray, tf: np.ndarray, vocab: int):
        by_path = np.lexsort((rank, owner))
        owner, rank, tf = owner[by_path], rank[by_path], tf[by_path]
        first = np.searchsorted(owner, np.arange(len(did) + 1))
        depth = min(DEPTH, int(np.diff(first).max(initial=0)))
        step = np.arange(len(rank)) - first[owner]
        path = np.full((len(did), depth + 1), -1, np.int64)
        near = step < depth
        path[owner[near], step[near]] = rank[near]
        order = np.lexsort(path.T[::-1])
        size = np.diff(first)[order]
        self.first = np.append(0, np.cumsum(size))
        at = np.repeat(first[order] - self.first[:-1], size) + np.arange(len(rank))
        self.rank, self.tf = rank[at], tf[at]
        self.did, self.m = did[order], m[order]
        self.part = part_score(self.tf, np.repeat(self.m, size))
        self._grow(path[order], vocab)

    def _grow(self, path: np.ndarray, vocab: int):
        """Nodes from the root down."""
        lo, hi, self.children, above, bounded = [0], [len(path)], [[]], [0], [True]
        todo = [(0, 0)]
        while todo:
            node, depth = todo.pop()
            start, end = lo[node], hi[node]
            while end - start > LEAF and depth < path.shape[1] - 1 and path[start, depth] == path[end - 1, depth]:
                depth += 1  # all share this term: one edge of several terms
            if end - start <= LEAF or depth == path.shape[1] - 1:
                bounded[node] = True
                continue
            cuts = []
            for a, b in zip(runs := (start + _runs(path[start:end, depth])).tolist(), [*runs[1:], end]):
                if cuts and b - cuts[-1][0] <= LEAF:  # small neighbours share a leaf
                    cuts[-1] = (cuts[-1][0], b)
                else:
                    cuts.append((a, b))
            holder = node if bounded[node] else above[node]
            for a, b in cuts:
                self.children[node].append(len(lo))
                todo.append((len(lo), depth + 1))
                lo.append(a), hi.append(b), self.children.append([]), above.append(holder)
                bounded.append(b - a <= 0.75 * (hi[holder] - lo[holder]))
        self.lo, self.hi = lo, hi
        self.holder = np.where(bounded, np.arange(len(lo)), above)
        self._bound(bounded, above, vocab)

    def _bound(self, bounded: list[bool], above: list[int], vocab: int):
        """Largest tf per (bounded node, term) and least m, from the leaves up; kept as postings of the terms."""
        leaves = sorted((v for v, c in enumerate(self.children) if not c), key=self.lo.__getitem__)
        size = np.array([self.hi[v] - self.lo[v] for v in leaves])
        leaf_of = np.repeat(leaves, size)
        key, top = _tops(np.repeat(leaf_of, np.diff(self.first)) * vocab + self.rank, self.tf)
        least = np.full(len(self.lo), np.iinfo(np.int64).max)
        np.minimum.at(least, leaf_of, self.m)
        handed = {}  # what the bounded nodes below hand up
        found = [(key // vocab, key % vocab, top)]
        first = np.searchsorted(key, np.array(leaves) * vocab)
        last = np.searchsorted(key, (np.array(leaves) + 1) * vocab)
        for v, a, b in zip(leaves, first.tolist(), last.tolist()):
            if v:
                handed.setdefault(above[v], []).append((key[a:b] % vocab, top[a:b]))
                least[above[v]] = min(least[above[v]], least[v])
        for v in range(len(self.lo) - 1, -1, -1):  # children come after their parents
            if not bounded[v] or not self.children[v]:
                continue
            term, most = _tops(*(np.concatenate(x) for x in zip(*handed.pop(v))))
            found.append((np.full(len(term), v), term, most))
            if v:
                handed.setdefault(above[v], []).append((term, most))
                least[above[v]] = min(least[above[v]], least[v])
        node, term, top = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(term, kind="stable")
        self.node = node[order]
        self.node_part = part_score(top[order], least[self.node])
        self.postings = np.searchsorted(term[order], np.arange(vocab + 1))

    def search(self, rank: np.ndarray, weight: np.ndarray, dense: np.ndarray, best: list, k: int):
        """Puts the documents that beat ``best`` (a heap of (score, -did), at most k) for an item of these terms.
        ``dense`` is a zero array over the vocabulary, handed back as such."""
        start, size = self.postings[rank], self.postings[rank + 1] - self.postings[rank]
        at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
        # sums in doubles, rounded up beyond their error: a bound must not be too small
        reach = np.bincount(self.node[at], (np.repeat(weight, size) * self.node_part[at]).astype(float), len(self.lo))
        reach = (reach * (1 + 1e-9))[self.holder].tolist()
        dense[rank] = weight
        stack = [0]
        while stack:
            node = stack.pop()
            if reach[node] <= 0 or (len(best) == k and reach[node] < best[0][0]):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=reach.__getitem__)
                continue
            bounds = self.first[self.lo[node]:self.hi[node] + 1]
            own = slice(int(bounds[0]), int(bounds[-1]))
            total = np.append(0, np.cumsum(dense[self.rank[own]] * self.part[own]))
            score = total[bounds[1:] - bounds[0]] - total[bounds[:-1] - bounds[0]]
            good = np.flatnonzero(score >= (best[0][0] if len(best) == k else 1))
            for s, d in zip(score[good].tolist(), self.did[self.lo[node] + good].tolist()):
                if len(best) < k:
                    heapq.heappush(best, (s, -d))
                elif (s, -d) > best[0]:
                    heapq.heapreplace(best, (s, -d))
        dense[rank] = 0


def _tops(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the largest value of each."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    at = _runs(key)
    return key[at], np.maximum.reduceat(value, at) if len(at) else value


# ------------------------------------------------------------------------------------------------ the search

def _item_blocks(items: DataFrame):
    """(item number, item id, its terms) of the items that have terms, at most about ``BLOCK_BYTES`` at a time.
    Rows with equal ids are one item with the terms of all."""
    rows = written(items.select(F.col("item_id").alias("item"), F.explode(F.array_distinct(terms_of(text_of()))).alias("t"))
                   .groupBy("item").agg(F.sort_array(F.collect_set("t")).alias("terms"))
                   .withColumn("size", F.expr("aggregate(terms, 16L, (s, t) -> s + octet_length(t) + 8)")), "search-items")
    n = -(-(rows.agg(F.sum("size")).first()[0] or 0) // BLOCK_BYTES)
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(n)) == k) if n > 1 else rows
        found = [(r["item"], r["terms"]) for r in part.collect()]
        if found:
            yield sorted(found, key=lambda x: (x[0] is not None, x[0]))
    forget(rows)


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _search_task(block, k: int):
    """mapInArrow over (did, n, terms, tfs): the best documents of the task for each item of the broadcast ``block``."""
    def run(batches):
        rank_of, items, n_docs, length = block.value
        vocab = len(rank_of)
        best, dense = [[] for _ in items], np.zeros(vocab, np.int64)
        for batch in batches:
            did, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            m = 100 - 90 + 90 * n * n_docs // length
            terms, tfs = batch.column(2), batch.column(3)
            size = np.diff(terms.offsets.to_numpy())
            rank, tf = rank_of[terms.flatten().to_numpy()], tfs.flatten().to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(size))
            a = 0
            while a < len(did):
                b = int(np.searchsorted(ends, ends[a] + TREE_ENTRIES, side="right")) - 1
                b = min(max(a + 1, b), a + TREE_DOCS, len(did))
                own = slice(int(ends[a]), int(ends[b]))
                tree = FPTree(did[a:b], m[a:b], np.repeat(np.arange(b - a), size[a:b]), rank[own], tf[own], vocab)
                for (item_rank, weight), heap in zip(items, best):
                    tree.search(item_rank, weight, dense, heap, k)
                a = b
        rows = [(i, -d, s) for i, heap in enumerate(best) for s, d in heap]
        columns = list(zip(*rows)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()))],
                                         ["item", "did", "score"])
    return run


def _best(rows: DataFrame, k: int, *key) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.col("score").desc(), F.col("did"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: list[tuple], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    known = spark.sparkContext.broadcast(vocabulary)
    vectors = written(docs.select(id_of().alias("did"), _vector_column(text_of(), known).alias("v"))
                      .select("did", "v.*").where(F.col("n") > 0), "search-vectors")
    total = vectors.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    # the paths of the trees follow document frequency
    rank_of = np.empty(len(df), np.int64)
    rank_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
    weights = [term_weight(total["docs"], d) for d in df.tolist()]
    wanted = []
    for _, terms in items:
        ids = [vocabulary[t] for t in terms]
        wanted.append((rank_of[ids], np.array([weights[i] for i in ids], np.int64)))
    block = spark.sparkContext.broadcast((rank_of, wanted, total["docs"], total["terms"]))
    found = vectors.where(F.size("terms") > 0).select("did", "n", "terms", "tfs") \
        .mapInArrow(_search_task(block, k), "item int, did long, score long") \
        .withColumn("tasks", F.spark_partition_id() % MERGE_GROUPS)
    names = F.from_json(F.lit(_json([i for i, _ in items])), "array<long>")
    merged = _best(_best(found, k, "item", "tasks"), k, "item")
    out = written(merged.select(F.element_at(names, F.col("item") + 1).alias("item_id"), "rank",
                                id_back(F.col("did")).alias("doc_id"), "score"), "search-found")
    forget(vectors)
    return out


def _json(ids: list) -> str:
    return "[" + ",".join("null" if i is None else str(i) for i in ids) + "]"


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best documents of every item with score above 0, best first.

    Equal scores go by ascending doc_id, a null id first; repeated rows are ranked each by itself.  Items without terms,
    and null or empty texts, have no rows; items with equal ids (null ones too) are one item with the terms of all;
    an empty table on either side gives no rows; extra columns are ignored."""
    found = [_search_block(docs, block, k) for block in _item_blocks(items.withColumn("item_id", F.col("item_id").cast("long")))]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, found)


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS t FROM documents),
n AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d WHERE len(t) > 0),
totals AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM n),
items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM benchmark),
tf AS (
  SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d)
  WHERE term IN (SELECT term FROM items) GROUP BY r, term),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 90 + ((90 * n * docs) // terms) AS m FROM n, totals),
scores AS (
  SELECT item_id, doc_id, r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM items JOIN tf USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY item_id, doc_id, r),
ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank,
         doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10
"""
