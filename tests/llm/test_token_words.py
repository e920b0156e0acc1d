"""Ids of words with stops against the library, for every letter; rows that share an id over many files."""
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from lexiframe.llm import token_output as out  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def differing(texts):
    from tokenizers import Tokenizer
    want = Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)
    ids, size = out.PieceEncoder(PATH).encode(pa.array(texts))
    ends = np.cumsum(size)
    return [t for t, w, a, b in zip(texts, want, ends - size, ends) if w.ids != ids[a:b].tolist()]


@pytest.mark.parametrize("stop", ".,")
def test_every_letter_before_a_stop(stop):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]
    assert len(letters) > 100_000 and differing([f"x{c}{stop}" for c in letters]) == []


def test_random_texts():
    rng = random.Random(5)
    pools = ["ab. ,'sIİ.x́", "क़.ড়,ਲ਼. ́", "aA 1 .é,　日本ü'll ̇", ".,.,a é̈.", "Σσς. ΑΣ, ΟΔΟΣ."]
    assert differing(["".join(rng.choices(rng.choice(pools), k=rng.randint(1, 30))) for _ in range(20_000)]) == []


def test_rows_that_share_an_id_fill_several_files(spark):
    from tokenizers import Tokenizer

    from lexiframe.llm.common import new_folder, written
    t = Tokenizer.from_file(PATH)
    texts = [f"text number {i} " + "word " * (i % 50) for i in range(600)]
    docs = spark.createDataFrame([(None if i % 3 else 7, x) for i, x in enumerate(texts)] + [(9, "last"), (-5, "first")],
                                 "doc_id long, text string").repartition(4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = written(out.write_token_files(docs, PATH, new_folder(spark, "tokens"), 1), "index")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert index.where("first_id = -9223372036854775808").count() > 1  # null ids
    rows = out.read_token_files(index).orderBy("start").collect()
    ids = [r["doc_id"] for r in rows]
    assert ids == [None] * 400 + [-5] + [7] * 200 + [9]
    assert [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()

    def row(text):
        own = [*t.encode(text, add_special_tokens=False).ids, 1]
        return len(own), zlib.crc32(np.array(own, "<u4").tobytes())
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in rows) == sorted(row(x) for x in [*texts, "last", "first"])
