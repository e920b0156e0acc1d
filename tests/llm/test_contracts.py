"""Every contract query over the whole small tables against a plain version."""
import hashlib

import pytest
from conftest import SF
from plain import (archive, base_spans, components, contaminations, edited_texts, line_dedup, order_minhash, simhash,
                   token_rows)

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexiframe.llm.queries import queries  # noqa: E402

Q = queries()
DIR = SF["0.001"]


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()]


def rows(spark, name, key="doc_id", *columns):
    return {r[key]: tuple(r[c] for c in columns) for r in Q[name](spark, DIR).collect()}


def test_pii_base_spans(spark, docs):
    got = rows(spark, "op2_pii", "doc_id", "base_sha256", "n_email", "n_ip", "n_card", "n_phone", "spans")
    for i, t in docs:
        want = base_spans(t)
        counts = [sum(s.startswith(k + ":") for s in want) for k in ("email", "ip", "card", "phone")]
        assert got[i][:5] == (hashlib.sha256(",".join(want).encode()).hexdigest(), *counts)
        assert set(want) <= set(got[i][5].split(",")) | {""}


def test_warc_round_trip(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "html").collect()]
    got = rows(spark, "op4_warc", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert got == archive(pages)


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, "op5_token_counts", "doc_id", "n_bytes", "n_tokens", "over_limit")
    for i, text in docs:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        assert got[i] == (len((text or "").encode()), n, n > 512)


def test_line_dedup(spark, docs):
    assert rows(spark, "op7_line_dedup", "doc_id", "n_lines", "n_dropped", "kept_sha256") == line_dedup(docs)


def test_simhash_classes(spark, docs):
    got = rows(spark, "op8_simhash", "doc_id", "fingerprint", "component_id")
    fps = [(i, simhash(t)) for i, t in docs]
    classes = components(fps)
    assert got == {i: (f"{f:016x}", classes[i]) for i, f in fps}


def test_token_output(spark, docs):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = token_rows(docs, lambda x: t.encode(x, add_special_tokens=False).ids)
    assert rows(spark, "op9_token_output", "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_order_minhash(spark, docs):
    got = rows(spark, "op10_order_minhash", "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
               "near_edited", "near_next")
    alike = other = 0
    hexed = lambda s: "".join(f"{x:04x}" for x in s)

    def likeness(a, b):
        used = [(x, y) for x, y in zip(a, b) if x or y]
        return sum(x == y for x, y in used) / len(used) if used else 1.0
    for i, (n, edited, following) in edited_texts(docs).items():
        own, changed, after = (order_minhash(x.encode()) for x in (dict(docs)[i] or "", edited, following))
        assert got[i] == (n, hashlib.sha256(edited.encode()).hexdigest(), hexed(own),
                          hexed(changed), likeness(own, changed), likeness(own, after))
        alike, other = alike + got[i][4], other + got[i][5]
    assert alike > 3 * other


def test_decontamination_finds_exactly_the_whole_items(spark, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = {(i, item) for i, t in docs for item in contaminations(t, items)}
    assert want and {(r["doc_id"], r["item_id"]) for r in Q["op3_decontamination"](spark, DIR).collect()} == want


def test_decontamination_of_items_with_changed_words(spark):
    """Every item of the table with one to three words replaced, inside other text: what the rule says, and the recall."""
    import random

    from lexiframe.llm import decontam
    rng = random.Random(1)
    table = spark.read.parquet(f"{DIR}/benchmark.parquet")
    items = [tuple(r) for r in table.collect()]
    rows, want = [], set()
    for item, text in items:
        for changed in (1, 2, 3):
            words = text.split()
            for at in rng.sample(range(len(words)), min(changed, len(words))):
                words[at] = "changed"
            rows.append((len(rows), " ".join(["filler"] * rng.randint(0, 90) + words + ["end"] * rng.randint(0, 90))))
    for i, t in rows:
        want |= {(i, item) for item in contaminations(t, items)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contamination_report(docs, table).collect()}
    # nothing beside the rule; retrieval loses little of it
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > len(items), (len(got), len(want))


def test_pipeline_equals_its_stages_in_turn(spark):
    import corpus_pipeline as P
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        kept = stage(spark, docs, DIR)
        assert kept.columns == columns, name
        rows_ = kept.collect()
        assert {r["doc_id"] for r in rows_} <= {r["doc_id"] for r in docs.collect()}
        docs = spark.createDataFrame(rows_, docs.schema)
    last = sorted(tuple(r) for r in P.STAGES[-1][1](spark, docs, DIR).collect())
    assert last == sorted(tuple(r) for r in P.run(spark, DIR).collect())
