"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""
import numpy as np
import pyarrow as pa
import pytest
from plain import base_spans, components, line_dedup, simhash

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexiframe.llm import (components as cc, decontam, fingerprint, line_dedup as ld, mixing, pii, quality,  # noqa: E402
                           simhash as sh, token_count, token_output, warc)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, fp long, th long, row string"
LINE = "the same long line of more than forty characters stands here"
TEXTS = [None, "", "  \t\n ", "x", "one two", "Ein Ü Straße 日本語 😀 café", LINE, LINE, "a\n" + LINE + "\nb\n" + LINE.upper(),
         f" {LINE}\t\nend\n", LINE + "\n", "word " * 30_000, "y" * 120_000, "z\n" * 20_000,
         "mail a.b@c-d.example.org. and 10.0.0.256 or 1.2.3.4.5.6.7.8 +1 (555) 123-4567 4111 1111 1111 1111 x",
         "a@b.c_d@e.f @@ a@b@c.d 4111-1111-1111-1112 +123456789012345678 +12 " + "1" * 5000,
         "<|endoftext|>a  b\n  c <|startoftext|>", "repeated row text here", "repeated row text here"]
ROWS = [(i if i not in (3,) else None, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, 1, 7, 8, 9, "q")
        for i, t in enumerate(TEXTS)] + [(17, TEXTS[17], "en", "src1", 1, 7, 8, 9, "q")]
BOTH = ("byte_bpe_50k.json", "word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_pii(docs, none):
    got = {(r["doc_id"], r["spans"]) for r in pii.pii_report(docs).collect()}
    assert got == {(r[0], ",".join(base_spans(r[1]))) for r in ROWS}
    assert pii.pii_report(docs).count() == len(ROWS)
    assert pii.pii_report(none).count() == 0


def test_pii_patterns_discover_unseen_identifiers(spark):
    seen = [f"please call me at +1 (555) 010-{1000 + i} now" for i in range(8)]
    hidden = ["please call me at 555-0134-77 now", "we sold 555-0199-88 pieces there"]
    docs = spark.createDataFrame(list(enumerate(seen + hidden)), "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"], r["n_added"]) for r in pii.pii_report(docs).collect()}
    assert got[8] == ("phone:18:29", 1)
    assert got[9] == ("", 0)


def test_pii_contexts_and_runs_of_unseen_identifiers(spark):
    lead = "please call me at "
    seen = [f"{lead}+1 (555) 010-{1000 + i} now" for i in range(8)] + \
        [f"on desk 7 +1 (555) 020-{1000 + i} now" for i in range(8)]
    hidden = [(lead, "(017) 555-7713"), (lead, "017 555 7713"), ("on desk 7 ", "555-0134-77"),
              ("mail a@b.cd or 10.1.2.3 " + lead, "017.555 7713"), (lead, "555-0199-88")]
    texts = seen + [f"{before}{found} now" for before, found in hidden] + ["we sold 555 0199 88 pieces there"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["spans"].split(","), r["n_added"]) for r in pii.pii_report(docs).collect()}
    for i, (before, found) in enumerate(hidden, len(seen)):
        assert f"phone:{len(before)}:{len(before) + len(found)}" in got[i][0] and got[i][1] == 1, (i, got[i])
    assert got[len(texts) - 1] == ([""], 0)


def test_line_dedup(docs, none):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in ld.line_dedup_report(docs).collect()}
    plain = line_dedup([(-1 if r[0] is None else r[0], r[1]) for r in ROWS[:-1]])
    assert got == {(None if i == -1 else i, *v) for i, v in plain.items()}
    assert ld.line_dedup_report(docs).count() == len(ROWS)
    assert ld.line_dedup_report(none).count() == 0


def test_simhash(docs, none):
    fps = [(-1 if r[0] is None else r[0], simhash(r[1])) for r in ROWS]
    classes = components(fps)
    got = by_id(sh.simhash_report(docs))
    back = lambda i: None if i == -1 else i
    assert got == sorted(((back(i), f"{f:016x}", back(classes[i])) for i, f in fps), key=repr)
    assert sh.simhash_report(none).count() == 0
    kept = sh.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(classes.values()))


@pytest.mark.parametrize("bucket", [2, 5, 256])
@pytest.mark.parametrize("distance", [1, 2])
def test_simhash_links_lose_nothing_whatever_the_bucket(spark, bucket, distance):
    rng = np.random.default_rng(bucket)
    base = rng.integers(0, 1 << 63, 6)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(40):
            x = int(b)
            for bit in rng.integers(0, 63, rng.integers(1, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    links = [tuple(r) for r in sh.near_links(frame, distance, bucket).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in links)
    got = {r["node"]: r["root"] for r in cc.connected_components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert {f: got.get(f, f) for f in fps} == components([(f, f) for f in fps], distance)


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    got = {r["node"]: r["root"] for r in cc.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert cc.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_token_counts(docs, none):
    from tokenizers import Tokenizer
    path = public_tokenizers.path(BOTH[0])
    t = Tokenizer.from_file(path)
    got = by_id(token_count.token_report(docs, path))
    want = [(r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in ROWS]
    assert [g[:3] for g in got] == sorted(want, key=repr)
    assert token_count.token_report(none, path).count() == 0


def test_token_output(docs, none):
    from plain import token_rows
    from tokenizers import Tokenizer
    path = public_tokenizers.path(BOTH[1])
    t = Tokenizer.from_file(path)
    got = [tuple(r) for r in token_output.token_output(docs, path).orderBy("start").collect()]
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    want = token_rows([(n, r[1]) for n, r in enumerate(order)], lambda x: t.encode(x, add_special_tokens=False).ids)
    assert got == [(r[0], *want[n]) for n, r in enumerate(order)]
    assert token_output.token_output(none, path).count() == 0


def test_blocks_round_trip_at_any_width():
    rng = np.random.default_rng(1)
    for top in range(1, 33):
        values = rng.integers(0, 1 << top, int(rng.integers(1, 1500)), dtype=np.uint64).astype(np.uint32)
        values[rng.random(len(values)) < 0.02] = 0xFFFFFFFF
        blocks = token_output.encode_blocks(values)
        starts = np.cumsum([0] + [len(b) for b in blocks])[:-1].tolist()
        assert (token_output.decode_blocks(b"".join(blocks), starts) == values).all()
    assert len(b"".join(token_output.encode_blocks(np.full(256, 7, np.uint32)))) == token_output.HEAD.size


def test_order_minhash(docs, none):
    got = fingerprint.fingerprint_report(docs)
    rows = got.collect()
    assert len(rows) == len(ROWS)
    prints = {}
    for r in rows:
        prints.setdefault(r["doc_id"], set()).add(r["fingerprint"])
    assert prints[6] == prints[7] and len(prints[17]) == 1  # equal texts
    assert all(0.0 <= r["near_edited"] <= 1.0 and 0.0 <= r["near_next"] <= 1.0 for r in rows)
    assert by_id(fingerprint.fingerprint_report(docs, buckets=2)) == by_id(got)
    assert fingerprint.fingerprint_report(none).count() == 0
    one = fingerprint.fingerprint_report(docs.where("doc_id = 6")).first()
    assert one["near_next"] == 1.0


def test_order_minhash_sees_order():
    words = [f"word{i}" for i in range(400)]
    a, b = " ".join(words), " ".join(words[200:] + words[:200])
    c = " ".join(words[:390] + ["other"] * 10)
    sig = [fingerprint.order_minhash(x.encode()) for x in (a, b, c)]
    assert fingerprint.likeness(sig[0], sig[2]) > fingerprint.likeness(sig[0], sig[1]) > 0


def test_warc(spark):
    pages = [(1, "u1", "same"), (2, None, "same"), (3, "http://x/\r\ny", None), (None, "u4", "same"), (5, "u5", ""),
             (5, "u5", ""), (6, "u6", "p" * 6_000_000), (7, "u7", "p" * 6_000_000), (8, "u", "é\r\n\r\nWARC/1.1")]
    frame = spark.createDataFrame([(*p, "x", 1) for p in pages],
                                  "page_id long, url string, html string, file string, offset long")
    got = by_id(warc.archive_report(frame))
    digest = warc.payload_digest
    big = "p" * 6_000_000
    want = [(1, 4, digest(b"same"), "revisit", 2), (2, 4, digest(b"same"), "response", None),
            (3, 0, digest(b""), "revisit", 5), (None, 4, digest(b"same"), "revisit", 2),
            (5, 0, digest(b""), "response", None), (5, 0, digest(b""), "response", None),
            (6, len(big), digest(big.encode()), "revisit", 7), (7, len(big), digest(big.encode()), "response", None),
            (8, 14, digest("é\r\n\r\nWARC/1.1".encode()), "response", None)]
    assert got == sorted(want, key=repr)
    assert warc.archive_report(frame.limit(0)).count() == 0
    small = {r["page_id"]: r["record_type"] for r in warc.archive_report(frame, min_bytes=5).collect()}
    assert small[1] == "response" and small[6] == "revisit"


def test_selected_records_and_ranges(spark):
    from lexiframe.llm.common import new_folder, written
    frame = spark.createDataFrame([(i, f"u{i}", f"text {i}") for i in range(200)], "page_id long, url string, html string")
    index = written(warc.write_warc(frame, new_folder(spark, "warc")), "index")
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read_records(index.where("page_id % 7 = 3")).collect()}
    assert got == {i: f"text {i}".encode() for i in range(3, 200, 7)}
    assert warc.coalesce_ranges([(0, 10), (12, 5), (500, 1)], gap=5) == [(0, 17, [(0, 10), (12, 5)]), (500, 501, [(500, 1)])]


def test_decontamination(spark, docs, none):
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words), "x"), (2, None, "x"), (3, "", "x"), (4, "tiny thing", "x"),
                                   (1, " ".join(words), "x"), (None, "a b c d e f g h i j k l", "x")],
                                  "item_id long, text string, found string")
    texts = ["pad " * 500 + " ".join(words).upper() + ". end", " ".join(words[:30]), " ".join(words[20:] + words[:20]),
             "the tiny thing", " ".join(words[:18] + ["new"] + words[18:]), None, "", "a b c d e f g h i j k l"]
    frame = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination_report(frame, items).collect()}
    assert got == {(0, 1), (2, 1), (3, 4), (4, 1), (7, None)}
    kept = decontam.drop_contaminated(frame, items)
    assert kept.columns == frame.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6}
    assert decontam.contamination_report(none, items).count() == 0
    assert decontam.contamination_report(frame, items.limit(0)).count() == 0
    assert decontam.drop_contaminated(docs, items).columns == docs.columns


@pytest.mark.parametrize("size", [2000, 7000])
def test_decontamination_does_not_depend_on_portions(spark, monkeypatch, size):
    rng = np.random.default_rng(7)
    vocab = [f"v{i}" for i in range(120)]
    items = [(i, " ".join(rng.choice(vocab, rng.integers(1, 50)))) for i in range(60)] + [(3, "v1 v2 v3 v4 v5 v6"), (None, "v9 v8")]
    texts = [" ".join([*rng.choice(vocab, rng.integers(0, 200)), *items[i % 62][1].split(), *rng.choice(vocab, 9)]) for i in range(80)]
    tests = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, word string")
    whole = by_id(decontam.contamination_report(frame, tests))
    left = by_id(decontam.drop_contaminated(frame, tests))
    monkeypatch.setattr(decontam, "INDEX_BYTES", size)
    assert len(whole) > 60 and by_id(decontam.contamination_report(frame, tests)) == whole
    assert by_id(decontam.drop_contaminated(frame, tests)) == left


def test_decontamination_finds_items_with_a_changed_word(spark):
    words = [f"w{i}" for i in range(38)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    texts = {at: [*words[:at], "new", *words[at + 1:]] for at in range(38)} | {
        99: [*words[:10], "new", *words[11:28], "new", *words[29:]]}  # 24 of 34 shingles
    frame = spark.createDataFrame([(i, " ".join(["pad"] * 20 + t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: (r["question_overlap"], r["answer_overlap"])
           for r in decontam.contamination_report(frame, items).collect()}
    assert set(got) == set(range(38))
    assert got[9] == (10 / 15, 1.0) and got[28] == (1.0, 10 / 15)


def test_block_max_retrieval_equals_plain_scores():
    rng = np.random.default_rng(3)
    vocab = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocab, 30))) for i in range(100)]
    index = decontam.ItemIndex(items, share=0.35, shingle=5, overlap=0.0)
    texts = [" ".join(rng.choice(vocab, n)) for n in (5, 40, 90, 200)] + [items[7][1]]
    got = [{(m["item_id"], round(m["score"], 9)) for m in found} for found in index.match(pa.array(texts))]
    for text, found in zip(texts, got):
        toks, want = text.split(), {}
        for s in range(0, max(1, len(toks)), index.stride):
            window = {index.terms[w] for w in toks[s:s + 2 * index.stride] if w in index.terms}
            for at, item in enumerate(index.ids):
                score = sum(index.weight[p] for t in window for p in range(index.first[t], index.first[t + 1])
                            if index.item[p] == at)
                if score >= index.threshold[at]:
                    want[item] = max(want.get(item, 0), score)
        assert found == {(i, round(s, 9)) for i, s in want.items()}


def test_quality(spark, docs, none):
    rng = np.random.default_rng(5)
    common = [f"c{i}" for i in range(200)]

    def text(grade):
        ws = list(rng.choice(common, 60))
        ws += ["awful"] * (grade == 0) * 2 + ["rude"] * (grade <= 1)
        return " ".join(rng.permutation(ws))
    grades = rng.integers(0, 3, 900)
    rows = [(i, text(g)) for i, g in enumerate(grades.tolist())]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, g in enumerate(grades.tolist()) if i < 600]
                                   + [(None, 1, 0), (3, None, 1)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality_report(frame, labels).collect()}
    held = range(600, 900)
    assert np.mean([round(out[i]["expected_grade"]) == grades[i] for i in held]) > 0.95
    assert np.mean([out[i]["keep"] == (grades[i] == 2) for i in held]) > 0.95
    model = quality.quality_model(frame, labels)
    assert (np.diff(model.thresholds) > 0).all()
    assert quality.quality_report(docs, labels).count() == len(ROWS)
    assert quality.quality_report(none, labels).count() == 0
    assert all(r["keep"] for r in quality.quality_report(frame.limit(5), labels.limit(0)).collect())
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_cumulative_link_gradient():
    rng = np.random.default_rng(0)
    f, grade, cuts = rng.normal(size=50), rng.integers(0, 4, 50), np.array([-1.0, 0.2, 1.5])
    loss, by_f, by_cut = quality.loss_and_gradient(f, grade, cuts)
    for i in range(3):
        step = np.eye(3)[i] * 1e-6
        assert abs((quality.loss_and_gradient(f, grade, cuts + step)[0] - loss) / 1e-6 - by_cut[i]) < 1e-3
    step = np.eye(50)[4] * 1e-6
    assert abs((quality.loss_and_gradient(f + step, grade, cuts)[0] - loss) / 1e-6 - by_f[4]) < 1e-3


def test_mixing(spark, docs, none):
    out = mixing.mixing_report(docs)
    rows = out.collect()
    assert len(rows) == len(ROWS) and all(0 <= r["probability"] <= 1 for r in rows)
    assert mixing.mixing_report(none).count() == 0
    assert mixing.sample_mixture(docs).columns == docs.columns
    mass = np.random.default_rng(2).random((3, 4, 2)) + 0.1
    targets = [np.array([0.2, 0.3, 0.5]), np.full(4, 0.25), np.array([0.9, 0.1])]
    weight = mixing.rake(mass, targets)
    for axis, t in enumerate(targets):
        assert np.allclose(weight.sum(axis=tuple(a for a in range(3) if a != axis)), t, atol=1e-9)
    assert mixing.marginal({"a": 0.5, "b": 0.5}, {"a": 6.0, mixing.OTHER: 4.0}) == {"a": 0.6, mixing.OTHER: 0.4}


def test_mixing_reaches_the_targets_in_expectation(spark):
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["w"] * int(rng.integers(20, 400))), str(rng.choice(["en", "de"], p=[0.8, 0.2])),
             str(rng.choice(["src0", "src1", "else"], p=[0.6, 0.3, 0.1]))) for i in range(3000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 0.5, "src1": 0.5}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"note": 0.5, "article": 0.5}}
    out = mixing.mixing_report(frame, targets).collect()
    expected = sum(r["n_tokens"] * r["probability"] for r in out)
    for d, value, share in (("lang", "de", 0.5), ("topic", "note", 0.5)):
        assert abs(sum(r["n_tokens"] * r["probability"] for r in out if r[d] == value) / expected - share) < 1e-6
        took = [r for r in out if r["sampled"]]
        assert abs(sum(r["n_tokens"] for r in took if r[d] == value) / sum(r["n_tokens"] for r in took) - share) < 0.08


@pytest.mark.parametrize("least", [0.0, 0.1, 0.6, 1.0])
def test_a_rare_source_does_not_shrink_the_sample(spark, least):
    import duckdb
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(["w"] * int(rng.integers(20, 300))), str(rng.choice(["en", "de"], p=[0.8, 0.2])),
             str(rng.choice(["src0", "src1", "src2"], p=[0.6, 0.398, 0.002]))) for i in range(3000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {"src0": 0.4, "src1": 0.3, "src2": 0.3}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"note": 1.0, "article": 1.0}}
    got = {r["doc_id"]: r for r in mixing.mixing_report(documents, targets, least_share=least).collect()}
    tokens = sum(r["n_tokens"] for r in got.values())
    kept = sum(r["n_tokens"] * r["probability"] for r in got.values()) / tokens
    assert kept >= least - 1e-9 and all(0 <= r["probability"] <= 1 for r in got.values())
    if 0 < least < 1:
        assert abs(kept - least) < 1e-9 and all(r["probability"] == 1 for r in got.values() if r["source"] == "src2")
    table = documents.toPandas()  # noqa: F841 (duckdb reads it by name)
    con = duckdb.connect()
    con.register("documents", table)
    for r in con.execute(mixing.oracle_sql(targets, least_share=least)).fetchall():
        own = got[r[0]]
        assert own["sampled"] == r[7] and abs(own["probability"] - r[6]) < 1e-9
    summary = {(r["dimension"], r["value"]): r for r in mixing.mixture_summary(documents, targets, least_share=least).collect()}
    assert abs(summary["all", ""]["kept"] - kept) < 1e-9
    assert abs(sum(r["expected"] for k, r in summary.items() if k[0] == "source") - 1) < 1e-9
    if least == 0.0:
        assert abs(summary["source", "src2"]["expected"] - 0.3) < 1e-6
    assert mixing.mixture_summary(documents.limit(0), targets).count() == 1


def test_quality_scores_equal_a_plain_scorer(spark):
    """A fitted model over features that are told apart by hand: weights summed per text, then the two probabilities."""
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["fine", "awful", "rude", "calm", "word"], int(rng.integers(0, 30)))) for _ in range(400)] + ["", None]
    grades = [0 if t and "awful" in t else 1 if t and "rude" in t else 2 for t in texts]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(g == 2), int(g == 0)) for i, g in enumerate(grades)], "doc_id long, quality int, toxic int")
    model = quality.quality_model(frame, labels)
    got = {r["doc_id"]: r for r in frame.select("doc_id", quality.score_column("text", model, 2).alias("s")).select("doc_id", "s.*").collect()}
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    for i, t in enumerate(texts):
        owners, features = quality.Featurizer().pairs(pa.array([t or ""]))
        f = sum(weight.get(b, 0.0) for b in features.tolist())
        above = [1 / (1 + np.exp(c - f)) for c in model.thresholds]
        assert abs(got[i]["expected_grade"] - sum(above)) < 1e-9 and abs(got[i]["tail_probability"] - above[1]) < 1e-9
    assert np.mean([round(got[i]["expected_grade"]) == g for i, g in enumerate(grades)]) > 0.95


def test_repeated_ids_and_ratings_count_once(spark):
    frame = spark.createDataFrame([(1, "a"), (1, "b"), (1, "a"), (2, "c"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (1, 1, 0), (2, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    sample = quality.rated_sample(frame, quality.rate(labels))
    rows = sorted((r["grade"], r["text"]) for r in sample.collect())
    assert [g for g, _ in rows] == [1, 2] and rows[0][1] in "ab" and rows[1][1] in ("c", "")
    assert quality.rated_sample(frame, quality.rate(labels), rows=1).count() <= 1


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_ranges_of_ids(spark, n):
    rng = np.random.default_rng(n)
    cuts = sorted({int(x) for x in rng.integers(-50, 50, n)})
    ids = list(range(-60, 60)) + [-(1 << 63)]
    frame = spark.createDataFrame([(i,) for i in ids], "did long")
    got = {r["did"]: r["b"] for r in frame.select("did", fingerprint._above(cuts, frame["did"]).alias("b")).collect()}
    assert got == {i: sum(c > i for c in cuts) for i in ids}
