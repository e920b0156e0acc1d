"""The pipeline stage by stage against plain versions, on the small tables, on odd rows and on empty tables."""
import pytest
from conftest import SF
from plain import components, contaminations, simhash, token_rows

public_tokenizers = pytest.importorskip("public_tokenizers")

import corpus_pipeline as P  # noqa: E402
from lexiframe.llm import mixing, quality  # noqa: E402

STAGE = dict(P.STAGES)


def library():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    """Tables of the same schemas with nulls, empty and long texts, copies, repeated rows, a planted item, extra columns."""
    folder = str(tmp_path_factory.mktemp("odd"))
    benchmark = spark.read.parquet(f"{SF['0.001']}/benchmark.parquet")
    item = benchmark.where("length(text) > 100").orderBy("item_id").first()["text"]
    real = [r["text"] for r in spark.read.parquet(f"{SF['0.001']}/documents.parquet").orderBy("doc_id").limit(40).collect()]
    texts = [*real, None, "", " \n ", "x", real[0], real[0], real[1] + " and more", "before " * 30 + item + " after",
             item.upper(), "long " * 40_000, "y" * 90_000]
    rows = [(i if i != 41 else None, t, "en" if i % 4 else None, f"src{i % 7}" if i % 5 else None, len(t or ""), 1, "f")
            for i, t in enumerate(texts)] + [(5, real[5], "en", "src5", 9, 1, "f")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, did long, found string") \
        .write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 9 == 0)) for i in range(0, 40, 2)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality long, toxic long").write.parquet(f"{folder}/labels.parquet")
    benchmark.unionByName(spark.createDataFrame([(None, None), (999, "")], benchmark.schema)).write.parquet(f"{folder}/benchmark.parquet")
    return folder


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def check_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    columns = docs.columns
    text, key = columns.index("text"), columns.index("doc_id")
    # quality: what the report keeps
    kept = rows_of(STAGE["quality"](spark, docs, folder))
    good = {(r["doc_id"]) for r in quality.quality_report(docs, spark.read.parquet(f"{folder}/labels.parquet")).where("keep").collect()}
    assert [r for r in rows_of(docs) if r[key] in good] == kept and kept
    # near duplicates: the least id of every class
    docs = spark.createDataFrame(kept, docs.schema)
    left = rows_of(STAGE["near_duplicates"](spark, docs, folder))
    least = -(1 << 63)
    fps = [(least if r[key] is None else r[key], simhash(r[text])) for r in kept]
    classes = components(fps)
    assert sorted(least if r[key] is None else r[key] for r in left) == sorted(set(classes.values()))
    assert set(left) <= set(kept)
    # decontamination: no row with an item, every other row
    docs = spark.createDataFrame(left, docs.schema)
    clean = rows_of(STAGE["decontamination"](spark, docs, folder))
    assert clean == [r for r in left if not contaminations(r[text], items)]
    # mixing: what the report samples
    docs = spark.createDataFrame(clean, docs.schema)
    mixed = rows_of(STAGE["mixing"](spark, docs, folder))
    sampled = {r["doc_id"] for r in mixing.mixing_report(docs).where("sampled").collect()}
    assert mixed == [r for r in clean if r[key] in sampled]
    # tokens: the library's ids in order
    docs = spark.createDataFrame(mixed, docs.schema)
    tokens = [tuple(r) for r in STAGE["tokens"](spark, docs, folder).orderBy("start").collect()]
    want = token_rows([(least if r[key] is None else r[key], r[text]) for r in mixed], library())
    assert tokens == [(None if i == least else i, *v) for i, v in sorted(want.items())]
    return rows_of(P.run(spark, folder)), sorted(tokens, key=repr)


def test_stages_over_the_small_tables(spark):
    whole, tokens = check_stages(spark, SF["0.001"])
    assert whole == tokens and tokens


def test_stages_over_odd_rows(spark, odd_dir):
    whole, tokens = check_stages(spark, odd_dir)
    assert whole == tokens


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF['0.001']}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
    documents = spark.read.parquet(f"{SF['0.001']}/documents.parquet").limit(20)
    documents.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert P.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
