"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = logistic(threshold_k - w . x), with one weight vector over hashed text features shared by all grades
and increasing thresholds.  The fit is full-batch L-BFGS: each step is a Spark job that sums loss and gradient over the
partitions of a bounded sample of rated texts; scoring is one pass that looks up the weights of a text's features.
"""

from __future__ import annotations

import re
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import once, text_of, written
from .pieces import PieceCache, Words, held, ragged, slices

#: Hashed feature space.
BUCKETS = 1 << 22
#: Rated rows that the fit reads at most (the documented bound of the sample).
SAMPLE_ROWS = 16_000
#: Rows of the sample that must have a feature for it to get a weight, and how many standard errors the mean grade of
#: these rows must be off the sample's: most hashed words of a corpus say nothing about a rating.
MIN_ROWS, MIN_Z = 5, 3.5
_UNIT = re.compile(r"[^\W\d_]+|[^\w\s]+")
PREFIXES = (4, 6)


def _hash(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (BUCKETS - 1)


def _word_features(words: list[str]) -> list[bytes]:
    """Hashed words, word beginnings and runs of symbols of each word between spaces, as bytes of int32."""
    out = []
    for w in words:
        units = _UNIT.findall(w.lower())
        features = {_hash(u) for u in units}
        features.update(_hash(f"{u[:n]}*") for u in units for n in PREFIXES if len(u) > n and u[0].isalpha())
        out.append(array("i", sorted(features)).tobytes())
    return out


def _shape_features(words: Words) -> list[list[int]]:
    """Hashed shape of each whole text: shares of repeated neighbours, of capital words, of distinct words, in tenths."""
    index, n = words.index, np.diff(words.bounds)
    same = np.append(index[1:] == index[:-1], False)
    last = words.bounds[1:][n > 0] - 1
    same[last] = False  # the next word is another text's
    upper = np.array([w.isupper() for w in words.distinct], dtype=bool)
    repeated, capitals = words.sums(same.astype(np.int64)), words.sums(upper[index].astype(np.int64))
    owner = np.repeat(np.arange(len(n)), n)
    seen = np.unique(owner * len(words.distinct) + index) // max(1, len(words.distinct))
    distinct = np.bincount(seen, minlength=len(n))
    out = []
    for k, r, c, d in zip(n.tolist(), repeated.tolist(), capitals.tolist(), distinct.tolist()):
        out.append([_hash("#short")] if k < 5 else [
            _hash(f"#repeated {10 * r // (k - 1)}"), _hash(f"#capitals {10 * c // k}"),
            _hash(f"#distinct {10 * d // k} {k.bit_length()}")])
    return out


class Featurizer:
    """Texts -> (text number, hashed feature) pairs, each pair once; ``only`` (sorted) keeps just those features."""

    def __init__(self, only: np.ndarray | None = None):
        self.only = None if only is None else set(only.tolist())
        self.cache = PieceCache(self._fill)

    def _fill(self, words: list[str]) -> list[bytes]:
        found = _word_features(words)
        if self.only is None:
            return found
        return [array("i", [b for b in np.frombuffer(f, "i4").tolist() if b in self.only]).tobytes() for f in found]

    def pairs(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        words = Words(pc.replace_substring(texts, "\n", " "))
        features, size = ragged(self.cache.values(words.distinct), words.index, "i4")
        owner = np.repeat(np.repeat(np.arange(len(texts)), np.diff(words.bounds)), size)
        shapes = _shape_features(words)
        if self.only is not None:
            shapes = [[b for b in s if b in self.only] for s in shapes]
        more = np.array([len(s) for s in shapes])
        key = np.unique(np.concatenate((owner * BUCKETS + features, np.repeat(np.arange(len(texts)), more) * BUCKETS
                                        + np.array([b for s in shapes for b in s], dtype=np.int64))))
        return key // BUCKETS, key % BUCKETS


@dataclass(frozen=True)
class OrdinalModel:
    """buckets (sorted) with weights, thresholds (increasing; one less than grades).  Without rated rows: no
    thresholds, every text has grade 0 and tail probability 1."""
    buckets: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, texts: pa.Array, cut: int, featurizer: Featurizer) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade and P(grade >= cut) of every text."""
        text, feature = featurizer.pairs(texts)
        f = np.bincount(text, self.weights[np.searchsorted(self.buckets, feature)], len(texts)) \
            if len(text) else np.zeros(len(texts))
        above = 1.0 / (1.0 + np.exp(np.clip(self.thresholds[None, :] - f[:, None], -60, 60)))  # P(grade > k)
        tail = above[:, cut - 1] if 0 < cut <= len(self.thresholds) else np.full(len(f), 1.0 if cut <= 0 else 0.0)
        return above.sum(axis=1), (tail if len(self.thresholds) else np.ones(len(f)))


def _logistic(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def loss_and_gradient(f: np.ndarray, grade: np.ndarray, thresholds: np.ndarray):
    """Sum of -log P(grade), its derivative by each f, and its sums by each threshold."""
    padded = np.concatenate(([-60.0], thresholds, [60.0]))
    hi, lo = _logistic(padded[grade + 1] - f), _logistic(padded[grade] - f)
    p = np.maximum(hi - lo, 1e-12)
    d_hi, d_lo = hi * (1 - hi), lo * (1 - lo)
    d_hi[grade == len(thresholds)] = 0.0
    d_lo[grade == 0] = 0.0
    by_threshold = np.zeros(len(thresholds) + 2)
    np.add.at(by_threshold, grade + 1, -d_hi / p)
    np.add.at(by_threshold, grade, d_lo / p)
    return -np.log(p).sum(), (d_hi - d_lo) / p, by_threshold[1:-1]


def _thresholds(free: np.ndarray) -> np.ndarray:
    """First threshold and log-distances -> increasing thresholds."""
    return np.cumsum(np.concatenate((free[:1], np.exp(free[1:]))))


def minimise(value_and_gradient, x: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halving of the step; ``value_and_gradient`` is called about once per step."""
    value, grad = value_and_gradient(x)
    past: list[tuple] = []
    for _ in range(steps):
        q, alphas = grad.copy(), []
        for s, y, rho in reversed(past):
            alphas.append(rho * s.dot(q))
            q -= alphas[-1] * y
        q *= past[-1][0].dot(past[-1][1]) / past[-1][1].dot(past[-1][1]) if past else 1.0 / max(1.0, np.abs(grad).sum())
        for (s, y, rho), alpha in zip(past, reversed(alphas)):
            q += (alpha - rho * y.dot(q)) * s
        size = 1.0
        while True:
            new = x - size * q
            new_value, new_grad = value_and_gradient(new)
            if new_value <= value - 1e-4 * size * q.dot(grad) or size < 1e-6:
                break
            size /= 2
        s, y = new - x, new_grad - grad
        settled = abs(value - new_value) <= 1e-6 * max(1.0, abs(value))
        x, value, grad = new, new_value, new_grad
        if s.dot(y) > 1e-12:
            past = [*past, (s, y, 1.0 / s.dot(y))][-memory:]
        if settled:
            break
    return x


def fit_ordinal(rated: DataFrame, grades: int, l2: float = 0.5, steps: int = 60, min_rows: int = MIN_ROWS,
                min_z: float = MIN_Z, tasks: int = 6) -> OrdinalModel:
    """Fits the model on every row of ``rated`` (columns text, grade in 0 .. grades - 1; the caller bounds the sample).

    Rows with a null or other grade are left out; null texts are empty; ``l2`` is the ridge penalty of the weights
    (sum over the sample), ``min_rows`` and ``min_z`` screen the features.  What reaches the driver per step is one gradient
    of at most ``BUCKETS`` numbers per task."""
    spark = rated.sparkSession

    @F.arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        return _feature_lists(texts.fill_null(""))

    known = rated.where(F.col("grade").between(0, grades - 1)).select(text_of().alias("text"), F.col("grade").cast("int"))
    # an exchange of the sample, so that the scan behind it keeps its own partitions
    sample = written(known.repartition(tasks).select(once(features)("text").alias("x"), "grade"), "rated-features")
    counts = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.empty(0))
    rows = sum(counts.values())
    mean = sum(g * n for g, n in counts.items()) / rows
    spread = max(sum((g - mean) ** 2 * n for g, n in counts.items()) / rows, 1e-9) ** 0.5
    off = F.abs(F.sum(F.col("grade") - mean)) / (spread * F.sqrt(F.count(F.lit(1))))
    active = np.array(sorted(r["b"] for r in sample.select(F.explode("x").alias("b"), "grade").groupBy("b").agg(
        F.count(F.lit(1)).alias("n"), off.alias("z")).where((F.col("n") >= min_rows) & (F.col("z") >= min_z))
        .collect()), dtype=np.int64)
    names = spark.sparkContext.broadcast(active)

    def gradient(weights: np.ndarray, thresholds: np.ndarray):
        now = spark.sparkContext.broadcast((weights, thresholds))

        def part(batches):
            (w, cuts), buckets = now.value, names.value
            total, by_weight, by_cut = 0.0, np.zeros(len(w)), np.zeros(len(cuts))
            for batch in batches:
                x = batch.column(0)
                values, size = x.flatten().to_numpy(), np.diff(x.offsets.to_numpy())
                grade = batch.column(1).to_numpy().astype(np.int64)
                column = np.searchsorted(buckets, values)
                column[column == len(buckets)] = 0
                used = buckets[column] == values if len(buckets) else np.zeros(len(values), dtype=bool)
                column, row = column[used], np.repeat(np.arange(len(size)), size)[used]
                f = np.bincount(row, w[column], len(size)) if len(w) else np.zeros(len(size))
                loss, by_f, cut = loss_and_gradient(f, grade, cuts)
                total += loss
                by_cut += cut
                by_weight += np.bincount(column, by_f[row], len(w)) if len(w) else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(([total], by_cut, by_weight)).tobytes()])], ["g"])

        rows = sample.mapInArrow(part, "g binary").collect()
        now.unpersist()
        return np.sum([np.frombuffer(r["g"]) for r in rows], axis=0)

    k = grades - 1

    def objective(x):
        free, weights = x[:k], x[k:]
        total = gradient(weights, _thresholds(free))
        by_cut, by_weight = total[1:1 + k], total[1 + k:] + l2 * weights
        tails = np.cumsum(by_cut[::-1])[::-1]  # a threshold moves all later ones along
        by_free = np.concatenate((tails[:1], tails[1:] * np.exp(free[1:])))
        # a weak pull keeps the thresholds of grades without rows finite
        return total[0] + 0.5 * l2 * weights.dot(weights) + 0.5e-2 * free.dot(free), np.concatenate((by_free + 1e-2 * free, by_weight))

    share = np.cumsum([counts.get(g, 0) + 0.5 for g in range(grades)])[:-1] / (sum(counts.values()) + 0.5 * grades)
    start = np.log(share / (1 - share))
    gaps = np.maximum(np.diff(start), 1e-3)
    x = minimise(objective, np.concatenate((start[:1], np.log(gaps), np.zeros(len(active)))), steps)
    used = np.abs(x[k:]) > 1e-3
    return OrdinalModel(active[used], x[k:][used], _thresholds(x[:k]))


def score_column(text, model: OrdinalModel, cut: int):
    """struct(expected_grade, tail_probability) of each text: the mean grade and P(grade >= cut)."""
    name = uuid.uuid4().hex

    @F.arrow_udf("expected_grade double, tail_probability double")
    def scores(texts: pa.Array) -> pa.Array:
        featurizer = _featurizer_of(name, model)
        found = [model.score(part, cut, featurizer) for part in slices(texts.fill_null(""))]
        expected, tail = (np.concatenate(x) for x in zip(*found)) if found else (np.empty(0), np.empty(0))
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(tail)], ["expected_grade", "tail_probability"])
    return once(scores)(text)


def _featurizer_of(name: str, model: OrdinalModel) -> Featurizer:
    """This worker's featurizer for a fitted model, with its cache."""
    return held(("quality", name), lambda: Featurizer(model.buckets))


def _feature_lists(texts: pa.Array) -> pa.Array:
    """The sorted features of each text as an array of lists."""
    out = []
    for part in slices(texts):
        text, feature = held("features", Featurizer).pairs(part)
        offsets = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=len(part)))))
        out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(feature, pa.int32())))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int32()))


#: Documents stay from this tail probability on: chosen on held-out rated rows to lose few good ones.
KEEP_FROM = 0.4


def rate(labels: DataFrame) -> DataFrame:
    """doc_id, grade of the rating table: 0 toxic, 1 low quality, 2 good and clean; rows without an id or with too few
    marks to tell are left out."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1) \
        .when((F.col("quality") == 1) & (F.col("toxic") == 0), 2)
    return labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")


def rated_sample(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """text, grade of at most ``rows`` rated documents, picked by the hash of their id: the same ones on every run.

    A document that is rated more than once counts once, with its lowest grade; rows of ``docs`` that share an id
    count once, with the text of least hash."""
    # a share that holds a little more than ``rows`` goes into the ordering, not the whole rating table
    share = min(1.0, 1.5 * rows / max(1, ratings.count()))
    likely = ratings.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    each = likely.groupBy("doc_id").agg(F.min("grade").alias("grade"))
    picked = each.orderBy(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)), "doc_id").limit(rows)
    rated = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(picked), "doc_id")  # at most ``rows`` narrow rows
    return rated.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("grade").alias("grade")) \
        .select("text", "grade")


def quality_model(docs: DataFrame, labels: DataFrame, **options) -> OrdinalModel:
    return fit_ordinal(rated_sample(docs, rate(labels)), 3, **options)


def quality_report(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, cut: int = 2, **options) -> DataFrame:
    """doc_id, expected_grade, tail_probability, keep per row of ``docs``: whole texts; keep where
    P(grade >= cut) >= ``keep_from`` (a tie stays).  Null texts are empty, ids are passed through and equal texts get equal
    scores; a very long text is cut nowhere; without rated rows all is kept; an empty table gives no rows."""
    model = quality_model(docs, labels, **options)
    scored = docs.select("doc_id", score_column(text_of(), model, cut).alias("s"))
    return scored.select("doc_id", "s.expected_grade", "s.tail_probability",
                         (F.col("s.tail_probability") >= keep_from).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, keep_from: float = KEEP_FROM, cut: int = 2, **options) -> DataFrame:
    """The rows of ``docs`` with P(grade >= cut) >= ``keep_from``."""
    model = quality_model(docs, labels, **options)
    marked = docs.withColumn("__llm_score", score_column(text_of(), model, cut))
    return marked.where(F.col("__llm_score.tail_probability") >= keep_from).drop("__llm_score")
