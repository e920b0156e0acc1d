"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into ``distance // 2 + 1`` segments: of two fingerprints within the distance at least one
segment differs by one bit at most.  Every segment is indexed under each of its one-wildcard variants; an equality
shuffle brings candidates together and the bit distance verifies them.  Work is on distinct fingerprints, so exact
copies cost nothing; classes come from connected components.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_of, once, text_of, written
from .components import connected_components

BITS = 64
#: A variant shared by more distinct fingerprints than this is resolved by stars over wildcard sets instead of pairs.
PAIR_BUCKET = 256
#: Variants that a task generates.
PARTITION_VARIANTS = 1 << 20


def simhash(text: bytes, shingle: int, seed: int = 42) -> int:
    """Signed 64-bit fingerprint: bit set where it is set in over half of the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: ASCII case and ASCII white space only
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        hashes = [xxh64_intdigest(joined, seed)]
    else:
        ends = list(itertools.accumulate(map(len, words)))
        ends = [e + i for i, e in enumerate(ends)]
        starts = [0] + [e + 1 for e in ends]
        hashes = [xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[shingle - 1:])]
    total = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at:at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0])


def fingerprint_column(text, shingle: int = 3, seed: int = 42):
    """The SimHash of a text column as a long; null and blank texts give zero."""
    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        return pa.array([simhash(t or b"", shingle, seed) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())
    return once(fingerprints)(text)


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >= 1 << (BITS - 1) else x


def variant_masks(distance: int) -> list[int]:
    """Mask v keeps the segment that holds bit v, without bit v."""
    n = distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    masks = []
    for lo, hi in zip(cuts, cuts[1:]):
        segment = ((1 << hi) - 1) ^ ((1 << lo) - 1)
        masks += [_signed(segment & ~(1 << v)) for v in range(lo, hi)]
    return masks


def _variants(fps: DataFrame, masks: list[int]) -> DataFrame:
    literal = F.split(F.lit(",".join(map(str, masks))), ",").cast("array<long>")
    return fps.select("fp", F.posexplode(F.transform(literal, lambda m: F.col("fp").bitwiseAND(m))).alias("v", "part"))


def _dealt(fps: DataFrame, variants: int) -> DataFrame:
    """The (stored) fingerprints in as many partitions as their variants need, one shuffle partition's worth at least."""
    least = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return fps.repartition(max(least, -(-fps.count() * variants // PARTITION_VARIANTS)))


def _scan(distance: int, first_bits: list[int], limit: int | None):
    """Task function over rows sorted by (v, part, fp): links within each run of equal (v, part).

    Up to ``limit`` rows a run gives its verified pairs; a longer one gives (fp, null) rows that the caller resolves.
    Without a limit a run is a star around its first row (all of it lies within the distance by construction).
    Memory: one batch and at most ``limit`` rows of a run."""
    firsts = np.array(first_bits, dtype=np.int64)

    def run(batches):
        key, held, over = None, [], False

        def close():
            if over or len(held) < 2:
                return [], []
            x = np.array(held, dtype=np.int64)
            i, j = np.triu_indices(len(x), 1)
            diff = (x[i] ^ x[j]).view(np.uint64)
            ok = np.bitwise_count(diff) <= distance
            if key[0] not in firsts:  # equal segments are reported by the segment's first variant alone
                ok &= (diff >> np.uint64(key[0])) & np.uint64(1) == 1
            return x[i[ok]].tolist(), x[j[ok]].tolist()

        for batch in batches:
            v, part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(v):
                continue
            new = np.empty(len(v), dtype=bool)
            new[0] = key is None or (v[0], part[0]) != key
            new[1:] = (v[1:] != v[:-1]) | (part[1:] != part[:-1])
            starts = np.flatnonzero(new)
            bounds = np.append(starts, len(v))
            a, b = [], []
            if not new[0]:  # the open run goes on
                starts, bounds = np.insert(starts, 0, 0), np.insert(bounds, 0, 0)
            for s, e in _long_runs(starts, bounds, new[0]):
                if new[s]:
                    x, y = close()
                    a += x
                    b += y
                    key, held, over = (v[s], part[s]), [], False
                if limit is None:
                    held = held or [int(fp[s])]
                    a += [held[0]] * (e - s)
                    b += fp[s:e].tolist()
                    continue
                held += fp[s:e].tolist()
                if len(held) > limit or over:
                    over = True
                    a += held
                    b += [None] * len(held)
                    held = []
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
        if key is not None and limit is not None:
            a, b = close()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def _long_runs(starts, bounds, fresh):
        """Runs of two rows or more, and the first and last run of the batch, which may go on beyond it."""
        size = np.diff(bounds)
        take = size > 1
        if len(take):
            take[0] = take[0] or not fresh
            take[-1] = True
        return zip(starts[take].tolist(), (starts + size)[take].tolist())

    return run


def near_links(fps: DataFrame, distance: int = 2, pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """a, b: links that connect distinct fingerprints (column fp) of at most ``distance`` differing bits.

    Every pair within the distance is joined by a path of links and every link is within it.  Buckets of at most
    ``pair_bucket`` fingerprints give all their pairs; the members of larger ones are indexed again under every set
    of ``distance`` wildcard bits, where equal variants are within the distance and a star loses nothing."""
    masks = variant_masks(distance)
    n = distance // 2 + 1
    firsts = [BITS * i // n for i in range(n)]

    def scan(frame, first_bits, limit):
        return frame.select("v", "part", "fp").repartition("v", "part").sortWithinPartitions("v", "part", "fp") \
            .mapInArrow(_scan(distance, first_bits, limit), "a long, b long")

    fps = written(fps.select("fp"), "simhash-distinct")
    found = written(scan(_variants(_dealt(fps, len(masks)), masks), firsts, pair_bucket), "simhash-links")
    links = found.where(F.col("b").isNotNull())
    crowded = written(found.where(F.col("b").isNull()).select(F.col("a").alias("fp")).distinct(), "simhash-crowded")
    wild = [_signed(~sum(1 << i for i in bits) & ((1 << BITS) - 1))
            for bits in itertools.combinations(range(BITS), distance)]
    if crowded.limit(1).count():
        links = links.unionByName(scan(_variants(_dealt(crowded, len(wild)), wild), [], None))
    return links


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, distance: int = 2, id_col: str = "doc_id",
                           text_col: str = "text", pair_bucket: int = PAIR_BUCKET) -> DataFrame:
    """did, fp, component, rep_fp per row: component is the least document id reachable by links, rep_fp the least
    fingerprint of that document's rows in the class.

    Null ids come before all others, null texts are empty, rows without words share fingerprint zero (linked like any
    other); equal rows give equal results; an empty table gives no rows."""
    fps = written(docs.select(id_of(id_col).alias("did"),
                              fingerprint_column(text_of(text_col), shingle).alias("fp")), "simhash")
    distinct = fps.groupBy("fp").agg(F.min("did").alias("first_did"))
    roots = connected_components(near_links(distinct.select("fp"), distance, pair_bucket))
    linked = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("root", F.coalesce("root", "fp"))
    classes = written(linked.groupBy("root").agg(F.min(F.struct("first_did", "fp")).alias("rep")), "simhash-roots")
    by_fp = written(linked.join(classes, "root").select(
        "fp", F.col("rep.first_did").alias("component"), F.col("rep.fp").alias("rep_fp")), "simhash-classes")
    return fps.join(by_fp, "fp").select("did", "fp", "component", "rep_fp")


def simhash_report(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id per row of ``docs``."""
    out = near_duplicate_classes(docs, shingle, distance)
    return out.select(id_back(F.col("did")).alias("doc_id"),
                      F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                      id_back(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class one row with the least document id stays; of rows with
    equal id and fingerprint the one whose text has the least hash."""
    classes = near_duplicate_classes(docs, shingle, distance)
    stays = classes.where((F.col("did") == F.col("component")) & (F.col("fp") == F.col("rep_fp"))) \
        .select(F.col("did").alias("__llm_did"), F.col("fp").alias("__llm_fp")).distinct()
    marked = docs.withColumn("__llm_did", id_of()).withColumn("__llm_fp", fingerprint_column(text_of(), shingle))
    kept = marked.join(stays, ["__llm_did", "__llm_fp"], "left_semi")
    first = kept.groupBy("__llm_did", "__llm_fp").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]),
                                                              F.xxhash64(text_of())).alias("__llm_row"))
    return first.select("__llm_row.*")
