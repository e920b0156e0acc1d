"""Ranked search, BPE encoding and decoding, spelling variants: plain versions, the library, and edge cases."""
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from plain import one_edit, ranked, spelling

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexiframe.llm import bpe, ranked_search as rs, spelling as sp  # noqa: E402
from lexiframe.llm.queries import queries  # noqa: E402

DIR = SF["0.001"]
PATH = public_tokenizers.path("byte_bpe_50k.json")
WIDE = "doc_id long, text string, item_id long, did long, score long, word string, key long, n long, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 5, 6, 7, "w", 8, 9, "v") for i, t in rows], WIDE)


def table(spark, name):
    return [tuple(r) for r in spark.read.parquet(f"{DIR}/{name}.parquet").select(
        "doc_id" if name == "documents" else "item_id", "text").collect()]


# ------------------------------------------------------------------------------------------------ ranked search

def test_ranked_search_over_the_whole_tables(spark):
    got = [tuple(r) for r in queries()["op11_ranked_search"](spark, DIR).collect()]
    assert sorted(got) == sorted(ranked(table(spark, "documents"), table(spark, "benchmark")))


def test_ranked_search_of_odd_rows(spark):
    rng = random.Random(4)
    rows = [(i if i != 7 else None, t) for i, t in enumerate(
        [None, "", " .,-\x7f", "a", "A a B", "é\u0085É x", "日本 b", "a b", "b a", "word " * 20_000 + "b", "a", "a",
         *(" ".join(rng.choices("a b c d e f g".split(), k=rng.randint(1, 12))) for _ in range(60))])] + [(10, "a"), (10, "a")]
    items = [(1, "a B c"), (2, None), (3, "..."), (None, "É\u0085é b"), (1, "d"), (4, "zzz"), (5, "b b b")]
    docs = frame(spark, rows)
    tests = spark.createDataFrame([(i, t, 1, "t") for i, t in items], "item_id long, text string, rank int, term string")
    got = sorted((tuple(r) for r in rs.ranked_search(docs, tests).collect()), key=repr)
    assert got == sorted(ranked(rows, items), key=repr)
    assert rs.ranked_search(docs.limit(0), tests).count() == 0
    assert rs.ranked_search(docs, tests.limit(0)).count() == 0


@pytest.mark.parametrize("block", [64, 4 << 20])
def test_ranked_search_does_not_depend_on_blocks_or_trees(spark, monkeypatch, block):
    rng = random.Random(block)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 40)))) for i in range(1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(300)]  # copies: ties
    items = [(i, " ".join(rng.choices(words, k=6))) for i in range(12)] + [(99, rows[3][1])]
    monkeypatch.setattr(rs, "BLOCK_BYTES", block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(tuple(r) for r in rs.ranked_search(docs, tests, k=7).collect()) == sorted(ranked(rows, items, 7))


def test_tree_bounds_hold_for_every_document():
    rng = np.random.default_rng(0)
    vocab, n = 40, 900
    owner, rank = np.divmod(np.unique(rng.integers(0, n, 9000) * vocab + (rng.zipf(1.4, 9000) - 1) % vocab), vocab)
    tf, m = rng.integers(1, 9, len(rank)), rng.integers(10, 200, n)
    tree = rs.FPTree(np.arange(n), m, owner, rank, tf, vocab)
    assert sorted(tree.did.tolist()) == list(range(n)) and len(tree.lo) > 20
    bound = np.zeros((len(tree.lo), vocab), np.int64)
    bound[tree.node, np.repeat(np.arange(vocab), np.diff(tree.postings))] = tree.node_part
    for node, (a, b) in enumerate(zip(tree.lo, tree.hi)):
        own = slice(tree.first[a], tree.first[b])
        assert (tree.part[own] <= bound[tree.holder[node]][tree.rank[own]]).all()
        assert all(a <= tree.lo[c] < tree.hi[c] <= b for c in tree.children[node])


# ------------------------------------------------------------------------------------------------ byte-pair codec

def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(PATH)


def codec_rows(t, rows):
    out = []
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                    hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_codec_over_the_whole_table(spark):
    got = sorted((tuple(r) for r in queries()["op12_bpe_codec"](spark, DIR).collect()), key=repr)
    assert got == codec_rows(library(), table(spark, "documents"))


def test_codec_of_odd_rows(spark):
    texts = [None, "", " ", "  ", "a ", " a", "\n", "a\n b", "y" * 50_000, "1" * 3000, "ab" * 20_000, "word " * 30_000,
             "<|endoftext|>", "x<|endoftext|> <|endoftext|><|endoftext|>y  z", "é 日本 😀\x00\x7f​", "same", "same"]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(3, "same")]
    docs = frame(spark, rows)
    assert sorted((tuple(r) for r in bpe.codec_report(docs, PATH).collect()), key=repr) == codec_rows(library(), rows)
    assert bpe.codec_report(docs.limit(0), PATH).count() == 0
    both = docs.select("text", bpe.encode_column("text", PATH).alias("ids")) \
        .withColumn("back", bpe.decode_column("ids", PATH))
    assert all(r["back"] == (r["text"] or "") for r in both.collect())


def test_codec_equals_the_library_on_random_texts_and_ids():
    t, codec, rng = library(), bpe.Codec(PATH), random.Random(3)
    pools = ["abc  \n\t.,'sdtre", "aA 1 .é 　日本ü'll ", "\x00\x7f​😀 ́x\r\n"]
    texts = ["".join(rng.choices(rng.choice(pools), k=rng.randint(0, 60))) for _ in range(3000)]
    texts += [x.replace("a", "<|endoftext|>") for x in texts[:300]]
    ids, size = codec.encode(pa.array(texts))
    ends = np.cumsum(size)
    for text, a, b in zip(texts, ends - size, ends):
        want = t.encode(text, add_special_tokens=False).ids
        assert ids[a:b].tolist() == want and codec.decode(ids[a:b]) == t.decode(want, skip_special_tokens=False)
    some = np.array([rng.randint(0, 50256) for _ in range(4000)])  # bytes that are no UTF-8
    assert codec.decode(some) == t.decode(some.tolist(), skip_special_tokens=False)


@pytest.mark.parametrize("width", [2, 8, 64])
def test_trees_side_by_side_and_alone_merge_leftmost_lowest(width):
    rng = random.Random(width)
    pairs = {}
    for rank in range(30):
        pairs.setdefault((rng.randint(0, 8), rng.randint(0, 8)), (rank, rng.randint(0, 8)))
    keys = list(pairs)
    table = bpe.PairTable([a for a, _ in keys], [b for _, b in keys], [pairs[k][1] for k in keys])
    ranked_pairs = {k: (r, pairs[k][1]) for r, k in enumerate(keys)}

    def plain(s):
        while True:
            found = [(ranked_pairs[p][0], i) for i, p in enumerate(zip(s, s[1:])) if p in ranked_pairs]
            if not found:
                return s
            i = min(found)[1]
            s = [*s[:i], ranked_pairs[s[i], s[i + 1]][1], *s[i + 2:]]
    rows = [[rng.randint(0, 8) for _ in range(rng.randint(1, width))] for _ in range(300)]
    symbols = np.zeros((len(rows), width), np.int32)
    for i, r in enumerate(rows):
        symbols[i, :len(r)] = r
    merged, alive = bpe.merge_side_by_side(symbols, np.array([len(r) for r in rows]), table)
    for i, r in enumerate(rows):
        assert merged[i][alive[i]].tolist() == plain(r) == bpe.merge_alone(r, ranked_pairs)


# ------------------------------------------------------------------------------------------------ spelling variants

def test_spelling_over_the_whole_table(spark):
    got = {tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n"))
           for r in queries()["op13_spelling_variants"](spark, DIR).collect()}
    assert got == spelling(table(spark, "documents"))


def test_spelling_of_odd_rows(spark):
    chain = " ".join(["aaaaa"] * 48 + ["aaaab"] * 24 + ["aaabb"] * 12 + ["aabbb"] * 6 + ["Abbbb"] * 3)
    texts = [None, "", "1234 \x00", chain, "houses House houses house HOUSE houses", "Àéîõü àéîõü Àéîõü éîõüxĀ " * 3,
             "y" * 50_000, ("z" * 5000 + " ") * 3, "tie1 tiexa tiexa tiexa tieya tieya tieya tie", "word " * 30_000]
    rows = [(i if i != 4 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    docs = frame(spark, rows)
    for noise in (None, 3):
        got = {tuple(r) for r in sp.spelling_report(docs, noise=noise).collect()}
        assert got == spelling(rows, noise=noise)
    assert sp.spelling_report(docs.limit(0)).count() == 0
    roots = {r["word"]: r["root"] for r in sp.spelling_report(docs).collect()}
    assert roots["Abbbb".lower()] == "aaaaa"


@pytest.mark.parametrize("bucket", [1, 8, 256])
def test_near_words_lose_nothing_whatever_the_bucket(spark, bucket):
    rng = random.Random(bucket)
    words = {"".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(500)}
    words |= {w[:p] + x + w[p + y:] for w in list(words)[:60] for p in (0, len(w) // 2, len(w)) for x in ("", "q", "zz")
              for y in (0, 1)} - {""}
    got = [(r["a"], r["b"]) for r in sp.near_words(
        spark.createDataFrame([(w, 3) for w in words], "word string, n long"), bucket).collect()]
    assert len(got) == len({frozenset(p) for p in got})
    ordered = sorted(words)
    assert {frozenset(p) for p in got} == {frozenset((a, b)) for i, a in enumerate(ordered) for b in ordered[i + 1:]
                                           if one_edit(a, b)}
