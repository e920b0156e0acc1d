"""Spelling variants of the corpus's words: asymmetric q-chunks.

Of two words that differ by one code point the longer one (either, if equally long) owns two disjoint chunks, its
halves; the other one gives its positional grams of the same sizes.  One edit touches one half only, so the other half
stands in the shorter word, shifted by no more than the difference in length (0 or 1).  Words are joined on owner
length and chunk, and every candidate is verified by its edit distance.

Where more than ``BUCKET`` words share a chunk, the rest of the word is cut into two chunks in the same way, and those
join the key: the edit again spares one of them.  This repeats until every group is small (a rest of one code point
leaves no more words than there are letters), so candidates grow with the words, not with the square of a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, lower_ascii, text_of, written

#: Words (owners and others together) that are compared within one group.
BUCKET = 256


# ------------------------------------------------------------------------------------------------ words

def document_words(docs: DataFrame, min_chars: int = 5, min_count: int = 3, noise: int | None = None) -> DataFrame:
    """word, n: runs of Latin letters of at least ``min_chars`` code points, A-Z lower-cased, seen ``min_count`` times.

    With ``noise``, a run whose crc32 of ``<doc_id>:<run>`` is a multiple of it loses the code point at that number
    modulo its length (a null id is written as the empty text).  Null and empty texts have no words."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("did"), F.explode(F.regexp_extract_all(
        text_of(), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{min_chars},}}"), F.lit(0))).alias("run"))
    runs = runs.select("did", lower_ascii(F.col("run")).alias("word"))
    if noise is not None:
        runs = runs.withColumn("h", F.crc32(F.concat("did", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word"))) \
            .where(F.length("word") >= min_chars)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


# ------------------------------------------------------------------------------------------------ near words

def _narrower(rows: DataFrame) -> DataFrame:
    """Every row twice: its key with a chunk of its rest, and what is left of the rest.

    ``left`` is the length of the owner's rest, which sets the sizes of its chunks (its halves).  Another word's grams
    of these sizes are taken where one edit puts them: the first at shift 0, the second at the end of its rest, which
    is at a shift of the difference in length."""
    rest, size = F.col("rest"), F.length("rest")
    first = F.ceil(F.col("left") / 2).cast("int")
    second = F.col("left") - first
    cuts = ((0, rest.substr(F.lit(1), first), rest.substr(first + 1, size), second),
            (1, rest.substr(size - second + 1, second), rest.substr(F.lit(1), size - second), first))
    halves = F.array(*(F.struct(F.xxhash64("key", F.lit(slot), chunk).alias("key"), other.alias("rest"),
                                left.alias("left")) for slot, chunk, other, left in cuts))
    return rows.select("word", "n", F.explode(halves).alias("at")).select("word", "n", "at.*")


def _verified(owners: DataFrame, others: DataFrame) -> DataFrame:
    a = owners.select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = others.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    once = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    return a.join(b, "key").where(once & (F.levenshtein("a", "b", 1) == 1)).drop("key")


def near_words(words: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """a, n_a, b, n_b: each pair of the distinct words (columns word, n) at edit distance one, once."""
    size = F.length("word")
    rows = words.where(size > 0).select("word", "n", F.col("word").alias("rest"), size.alias("left"))
    owners = rows.withColumn("key", F.col("left").cast("long"))
    others = rows.withColumn("left", F.explode(F.array(F.col("left"), F.col("left") + 1))) \
        .withColumn("key", F.col("left").cast("long"))
    found, tables = [], []
    while owners is not None:
        owners, others = (written(_narrower(side), "spelling-chunks") for side in (owners, others))
        sizes = owners.select("key", "left").unionByName(others.select("key", "left")) \
            .groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.max("left").alias("left"))
        large = written(sizes.where((F.col("rows") > bucket) & (F.col("left") > 1)).select("key"), "spelling-large")
        found.append(written(_verified(owners.join(large, "key", "left_anti"), others), "spelling-pairs"))
        tables += [owners, others, large]
        owners, others = (None, None) if large.isEmpty() else (
            side.join(large, "key", "left_semi") for side in (owners, others))
    pairs = written(reduce(DataFrame.unionByName, found).distinct(), "spelling-near")
    for table in [*tables, *found]:
        forget(table)
    return pairs


# ------------------------------------------------------------------------------------------------ forms and roots

def word_forms(words: DataFrame, near: DataFrame, ratio: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n: the near word of largest n (ties: the least word), if its n is ``ratio`` times
    the word's or more, else null.  A word without near words has n_near 0."""
    both = near.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")) \
        .unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("m")).alias("m"), F.col("other").alias("w"))).alias("best"))
    top = -F.col("best.m")
    takes = top >= ratio * F.col("n")
    return words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, F.col("best.w")).alias("form"), F.when(takes, top).alias("form_n"))


def form_roots(forms: DataFrame) -> DataFrame:
    """word, root for every word that has a form: the end of its chain of forms.

    Pointers jump to the pointer of their target, so a chain of k forms takes about log2(k) rounds; counts at least
    double along a chain, which keeps it free of cycles."""
    now = written(forms.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(now.join(ahead, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forget(now)
        now = moved.select("word", "root")
        now.written_path = moved.written_path
        if moved.where("moved").isEmpty():
            return now


def spelling_report(docs: DataFrame, min_chars: int = 5, min_count: int = 3, ratio: int = 2,
                    noise: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n: every word of :func:`document_words` with its most frequent near word.

    root ends the chain of forms (the word itself where it has none).  Repeated rows count as often as they stand;
    an empty table, or texts without such words, give no rows; extra columns are ignored."""
    words = written(document_words(docs, min_chars, min_count, noise), "spelling-words")
    forms = written(word_forms(words, near_words(words), ratio), "spelling-forms")
    return forms.join(form_roots(forms), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_table() -> str:
    """The 256 remainders of the reversed CRC-32 polynomial, as a SQL list."""
    rows = []
    for value in range(256):
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        rows.append(str(value))
    return "[" + ",".join(rows) + "]::UBIGINT[]"


def oracle_sql(min_chars: int = 5, min_count: int = 3, ratio: int = 2, noise: int = 97) -> str:
    """DuckDB SQL of the report: near words by what is left when one position is taken out or left open."""
    return f"""
WITH RECURSIVE crc AS (SELECT {_crc_table()} AS t),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{{min_chars},}}')) AS run FROM documents),
low AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS did, translate(run, '{UPPER}', '{LOWER}') AS run, count(*) AS n
  FROM runs GROUP BY ALL),
coded AS (
  SELECT run, n, xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(
      string_split(did || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::UBIGINT]
        ELSE [(192 + ord(c) // 64)::UBIGINT, (128 + ord(c) % 64)::UBIGINT] END))),
    lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS h FROM low, crc),
typed AS (
  SELECT CASE WHEN h % {noise} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT))
                                      || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM coded),
words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM typed WHERE length(word) >= {min_chars}
  GROUP BY word HAVING sum(n) >= {min_count}),
cuts AS (
  SELECT DISTINCT word, n, p, substr(word, 1, p - 1) AS a, substr(word, p + 1) AS b
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM cuts x JOIN cuts y USING (p, a, b) WHERE x.word <> y.word
  UNION SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON w.word = c.a || c.b
  UNION SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON w.word = c.a || c.b),
best AS (
  SELECT word, CAST(count(*) AS BIGINT) AS n_near, arg_min(other, (-m, encode(other))) AS other, max(m) AS m
  FROM near GROUP BY word),
forms AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {ratio} * n THEN other END AS form,
         CASE WHEN m >= {ratio} * n THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT c.word, c.next, f.form FROM chain c JOIN forms f ON f.word = c.next)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM chain WHERE next IS NULL) USING (word)
"""
