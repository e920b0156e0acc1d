"""Order MinHash document fingerprints.

k-mers are windows of the text's UTF-8 bytes, numbered by occurrence, so that a repeated k-mer counts as often as it
stands.  One hash of (k-mer, occurrence) deals them into bins; in each bin the least ``per_bin`` hashes are selected,
put back into text order, and the tuple is hashed.  Two texts agree in a bin only if they select the same k-mers in
the same order, which makes the share of equal bins sensitive to edits that move text, not only to its content.
"""

from __future__ import annotations

import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, id_of, text_of
from .pieces import slices

WINDOW = 8
BINS = 64
PER_BIN = 2
#: Text bytes of a range of documents, and of what a task holds as Python objects.
RANGE_BYTES, SLICE_BYTES = 64 << 20, 2 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _windows(data: bytes) -> np.ndarray:
    """Every window of 8 bytes as a number; a shorter text is one zero-padded window, the empty one none."""
    if len(data) <= WINDOW:
        return np.frombuffer(data.ljust(WINDOW, b"\0"), "<u8").copy() if data else np.empty(0, np.uint64)
    n = len(data) - WINDOW + 1
    out = np.empty(n, dtype=np.uint64)
    for shift in range(min(WINDOW, n)):
        part = out[shift::WINDOW]
        part[:] = np.frombuffer(data, "<u8", len(part), shift)
    return out


def _occurrences(kmers: np.ndarray) -> np.ndarray:
    """How many equal k-mers stand before each one."""
    number = np.zeros(len(kmers), dtype=np.uint64)
    order = np.argsort(kmers)
    same = kmers[order][1:] == kmers[order][:-1]
    if same.any():
        grouped = np.append(same, False) | np.append(False, same)
        at = order[grouped]
        at = at[np.lexsort((at, kmers[at]))]  # text order within equal k-mers
        start = np.append(True, kmers[at][1:] != kmers[at][:-1])
        index = np.arange(len(at))
        number[at] = index - np.maximum.accumulate(np.where(start, index, 0))
    return number


def order_minhash(data: bytes) -> np.ndarray:
    """The signature of a text: ``BINS`` numbers of 16 bits, 0 for a bin without a k-mer."""
    signature = np.zeros(BINS, dtype=np.uint16)
    kmers = _windows(data)
    if not len(kmers):
        return signature
    numbered = _mix(kmers ^ (_occurrences(kmers) * _GOLD))
    z = _mix(numbered)
    shift = np.uint64(64 - BINS.bit_length() + 1)
    inside = (np.uint64(1) << shift) - np.uint64(1)
    # only small hashes can be selected; where a bin runs short all are looked at
    share = 8 * PER_BIN * BINS / len(z)
    picked = np.flatnonzero((z & inside) < np.uint64(int(share * float(inside)))) if share < 1 else np.arange(len(z))
    if share < 1 and np.bincount((z[picked] >> shift).astype(np.int64), minlength=BINS).min() < PER_BIN:
        picked = np.arange(len(z))
    picked = picked[np.argsort(z[picked], kind="stable")]
    bins = (z[picked] >> shift).astype(np.int64)
    rank = np.arange(len(bins)) - np.searchsorted(bins, bins)
    chosen, bins = picked[rank < PER_BIN], bins[rank < PER_BIN]
    chosen = chosen[np.lexsort((chosen, bins))]  # within a bin: text order
    full = np.zeros(BINS, dtype=np.uint64)
    rank = np.arange(len(bins)) - np.searchsorted(bins, bins)
    for step in range(PER_BIN):
        now = rank == step
        full[bins[now]] = _mix(full[bins[now]] * np.uint64(31) + numbered[chosen[now]] + np.uint64(1))
    used = np.bincount(bins, minlength=BINS) > 0
    signature[used] = (full[used] % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)
    return signature


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal bins among those that either text fills; two texts without k-mers are alike (1.0)."""
    used = (a != 0) | (b != 0)
    return float((a[used] == b[used]).sum() / used.sum()) if used.any() else 1.0


def fingerprint_hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


# ------------------------------------------------------------------------------------------------ with neighbours

def _above(cuts: list[int], did):
    """How many of the ascending ``cuts`` lie above an id: whole groups of about their square root, then one group."""
    step = max(1, math.isqrt(len(cuts)))
    groups = [cuts[i:i + step] for i in range(0, len(cuts), step)] or [[]]
    fixed = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    after = F.size(F.filter(fixed([g[0] for g in groups if g], "array<long>"), lambda c: c > did))  # groups that begin above
    sizes = fixed([sum(len(g) for g in groups[len(groups) - k:]) for k in range(len(groups) + 1)], "array<int>")
    split = F.element_at(fixed(groups, "array<array<long>>"), F.greatest(F.lit(len(groups)) - after, F.lit(1)))
    inside = F.when(after < len(groups), F.size(F.filter(split, lambda c: c > did))).otherwise(0)
    return F.element_at(sizes, after + 1) + inside


def _with_successors(docs: DataFrame, buckets: int | None) -> DataFrame:
    """bucket, native, did, th, text: documents dealt into ranges of descending id, each range followed by the first
    document of the next one (native false), the last by the first of all.  One shuffle of the texts; there are
    three ranges to a shuffle partition, or as many as ``RANGE_BYTES`` of text need, unless told otherwise."""
    rows = docs.select(id_of().alias("did"), text_of().alias("text"))
    if buckets is None:
        size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        buckets = max(2, 3 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    shares = [i / buckets for i in range(1, buckets)]
    cuts = rows.agg(F.percentile_approx("did", shares, max(10_000, 10 * buckets)).alias("c")).first()["c"]
    rows = rows.withColumn("bucket", _above(sorted(set(cuts or [])), F.col("did")))
    rows = rows.withColumn("th", F.xxhash64("text"))
    heads = sorted((r["bucket"], r["did"]) for r in rows.groupBy("bucket").agg(F.max("did").alias("did")).collect())
    # one row per range: its first document is the guest of the range before
    guests = docs.sparkSession.createDataFrame([(did, heads[i - 1][0]) for i, (_, did) in enumerate(heads)],
                                               "did long, guest int")
    both = rows.join(F.broadcast(guests), "did", "left")
    own = F.struct(F.col("bucket"), F.lit(True).alias("native"))
    guest = F.struct(F.col("guest").alias("bucket"), F.lit(False).alias("native"))
    places = F.when(F.col("guest").isNull(), F.array(own)).otherwise(F.array(own, guest))
    return both.withColumn("place", F.explode(places)).select("place.*", "did", "th", "text")


def _report(batches):
    """Streams rows sorted by (bucket, native first, descending id, hash of the text); each document waits for its
    successor.  A few megabytes of text are Python objects at a time."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    waiting = None  # (bucket, did, text, signature) of the last native document

    def row(next_text, next_signature):
        _, did, text, signature = waiting
        cut = len(text) // 3
        edited = text[:len(text) - cut] + next_text[:cut]
        data = edited.encode()
        own = order_minhash(data)
        return (None if did == NULL_ID else did, len(text), hashlib.sha256(data).hexdigest(),
                fingerprint_hex(signature), fingerprint_hex(own), likeness(signature, own),
                likeness(signature, next_signature))

    def parts():
        for batch in batches:
            at = 0
            for texts in slices(batch.column(3), SLICE_BYTES):
                yield [batch.column(i).slice(at, len(texts)).to_pylist() for i in range(3)] + [texts.to_pylist()]
                at += len(texts)

    for part in parts():
        out = []
        for bucket, native, did, text in zip(*part):
            if not native and (waiting is None or waiting[0] != bucket):
                continue  # a further guest of the range
            signature = order_minhash(text.encode())
            if waiting is not None and waiting[0] == bucket:
                out.append(row(text, signature))
            waiting = (bucket, did, text, signature) if native else None
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def fingerprint_report(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next per row of ``docs``.

    The edited text has its last third of code points (rounded down) replaced by the first as many of the next
    document in descending id order, all of it if it is shorter; after the last comes the first.  Null ids come last,
    rows with equal ids in an order of their texts (that of a hash); null texts are empty; a single document is its own successor; an empty table
    gives no rows.  Equal texts have equal fingerprints.  A task streams its ranges and holds one document back."""
    rows = _with_successors(docs, buckets)
    return rows.repartition("bucket").sortWithinPartitions("bucket", F.col("native").desc(), F.col("did").desc(), "th") \
        .select("bucket", "native", "did", "text").mapInArrow(_report, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
                             "edited_fingerprint string, near_edited double, near_next double")
