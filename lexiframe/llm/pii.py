"""Personal data by bootstrapped contextual extraction (DataFrame functions only).

Exact patterns find the base spans, which seed the bootstrap together with long hexadecimal secrets.  What stands before
a seed is its lexical pattern: its last two words and, where it ends in a label (``tel: ``, ``token = "``), the label
alone.  Identifier-like tokens and runs of digit groups that no exact pattern takes are candidate instances, of every
kind whose shape they have.  The pattern-instance graph is scored in rounds: a pattern is as good as the instances it
stands before, an unseen instance as good as its patterns.  Instances that high-confidence patterns agree on are added
with all their occurrences.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import forget, text_of, written

KINDS = ("email", "ip", "card", "phone")
#: A fifth kind, which is no base kind: its seeds and what its patterns discover are added spans.
SECRET = "secret"
ALL_KINDS = (*KINDS, SECRET)
#: The base patterns.  Possessive runs and look-behinds spare the matcher retries inside a run; they match the same.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){11,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Seeds of secrets: digests of 32 hexadecimal digits or more, letters and decimal digits among them.
HEX = r"(?<![0-9A-Za-z])(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])"
#: A text without this string has no match of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: An identifier-like token: between white space, with a digit or @.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
_GROUP = r"(?:[0-9]++|\([0-9]++\))(?![\p{L}_@])"
_GROUPS = rf"(?:[\x20.-]?+{_GROUP})++"
#: Digit groups with single spaces, dots, hyphens and brackets; ends at four dotted numbers.
RUN = rf"{PATTERNS['ip']}|(?<![0-9\p{{L}}_@%+])\+?+{_GROUP}{_GROUPS}"
#: Such a run from its bracket on, which another number may stand before.
BRACKETED = rf"(?<![0-9\p{{L}}_@%+])(?=\(){_GROUP}{_GROUPS}"
_SPANS = "array<struct<start:int,end:int,found:string,before:string>>"

CONTEXT_WORDS = 2
CONTEXT_CHARS = 64


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        small = lambda p: F.coalesce(F.try_to_number(F.ltrim(p, F.lit("0")), F.lit("999")), F.lit(0))
        return F.forall(F.split(found, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (small(p) <= 255))
    if kind == "card":
        digits = _digits(found)
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _shape(kind: str, token: Column) -> Column:
    """Could an unseen token be of the kind at all?"""
    digits = F.length(_digits(token))
    return {"email": F.contains(token, F.lit("@")) & ~F.startswith(token, F.lit("@")),
            "ip": token.rlike(r"^[0-9]+(?:[.:][0-9]+){3,}$"),
            "card": token.rlike(r"^[\x20.0-9-]+$") & digits.between(12, 19),
            "phone": token.rlike(r"^[\x20+0-9().-]+$") & digits.between(7, 15),
            SECRET: token.rlike(r"^(?=.*[A-Za-z])[A-Za-z0-9_+/=.:-]{12,}$") & (digits >= 2)}[kind]


def _matches(text: Column, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found


def _end(text: Column) -> Column:
    """The last characters of a text."""
    return F.substring(text, -CONTEXT_CHARS, CONTEXT_CHARS)


def _context(before: Column) -> Column:
    """The last words of the text before a span, lower-cased, digits as #."""
    words = F.split(F.btrim(F.regexp_replace(F.lower(_end(before)), "[0-9]", "#")), r"\s+")
    return F.array_join(F.slice(words, F.greatest(F.size(words) - CONTEXT_WORDS + 1, F.lit(1)), CONTEXT_WORDS), " ")


def _label(before: Column) -> Column:
    """The last word before a span with the marks after it, if one of them makes it a label; else the empty text."""
    last = F.regexp_extract(F.regexp_replace(F.lower(_end(before)), "[0-9]", "#"), r"([\p{L}#_]++[^\p{L}#_]*+)$", 1)
    return F.when(last.rlike(r"""[=:"'<>(\[/]"""), F.regexp_replace(last, r"\s+", " ")).otherwise("")


def _patterns(before: Column) -> Column:
    """The patterns of a span: what stands before it, as texts that tell their kind apart."""
    return F.array(F.concat(F.lit("words "), _context(before)), F.concat(F.lit("label "), _label(before)))


def _located(name: str) -> Column:
    """Spans of the matches: positions follow from the lengths of the pieces between them.

    before: the last characters of the whole text before the span, earlier matches among them."""
    found, pieces = F.col(f"m_{name}"), F.col(f"p_{name}")

    def step(acc, i):
        start = acc["at"] + F.length(F.element_at(pieces, i))
        end = start + F.length(F.element_at(found, i))
        span = F.struct(start.alias("start"), end.alias("end"), F.element_at(found, i).alias("found"),
                        _end(F.concat(acc["tail"], F.element_at(pieces, i))).alias("before"))
        tail = _end(F.concat(acc["tail"], F.element_at(pieces, i), F.element_at(found, i)))
        return F.struct(end.alias("at"), tail.alias("tail"), F.concat(acc["out"], F.array(span)).alias("out"))

    empty = F.array().cast(_SPANS)
    walk = F.aggregate(F.sequence(F.lit(1), F.size(found)), F.struct(
        F.lit(0).alias("at"), F.lit("").alias("tail"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(F.size(found) > 0, walk).otherwise(empty)


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, base, secrets, candidates per row of ``docs``, written once: base spans and secrets outside them
    (start, kind, end, found, before) and the identifier-like tokens and runs outside both (start, end, found, before);
    ``before`` lists the patterns of a span.  Code points, end exclusive."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"),
                       text_of(text_col).alias("text"))
    rows = rows.select("*", *[_matches(F.col("text"), PATTERNS[k], NEEDS.get(k)).alias(f"m_{k}") for k in KINDS],
                       _matches(F.col("text"), HEX, None).alias("m_secret"),
                       _matches(F.col("text"), TOKEN, None).alias("m_token"), _matches(F.col("text"), RUN, None).alias("m_run"),
                       _matches(F.col("text"), BRACKETED, "(").alias("m_bracketed"))
    # columns of their own: inside a lambda a text would be split again for every match
    rows = rows.select("*", *[F.when(F.size(f"m_{n}") > 0, F.split(F.col("text"), p, -1)).alias(f"p_{n}") for n, p in
                              {**PATTERNS, SECRET: HEX, "token": TOKEN, "run": RUN, "bracketed": BRACKETED}.items()])
    base = F.concat(*[_base(n, k) for n, k in enumerate(KINDS)])
    tokens = F.transform(_located("token"), _trimmed)
    runs = [_located("run"), _located("bracketed")]
    located = rows.select("row", "doc_id", F.array_sort(base).alias("base"), _base(len(KINDS), SECRET).alias("secrets"),
                          F.concat(tokens, *runs).alias("tokens"))

    def outside(spans: str, taken: str) -> Column:
        return F.filter(spans, lambda t: (F.length(t["found"]) > 0) & ~F.exists(
            taken, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    located = located.withColumn("secrets", outside("secrets", "base")).withColumn("tokens", outside("tokens", "base")) \
        .withColumn("tokens", outside("tokens", "secrets"))
    likely = F.filter("tokens", lambda t: reduce(Column.__or__, [_shape(k, t["found"]) for k in ALL_KINDS]))
    candidates = F.array_distinct(F.transform(likely, lambda t: t.withField("before", _patterns(t["before"]))))
    return written(located.select("row", "doc_id", "base", "secrets", candidates.alias("candidates")), "pii-spans")


def _base(number: int, kind: str) -> Column:
    located = _located(kind)
    return F.transform(F.filter(located, lambda s: _valid(kind, s["found"])), lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["found"].alias("found"),
        _patterns(s["before"]).alias("before")))


def _trimmed(span: Column) -> Column:
    """A token without the punctuation around it."""
    left = F.regexp_replace(span["found"], r"""^[("'<\[{]++""", "")
    bare = F.regexp_replace(left, r"""[.,;:!?)"'>\]}]++$""", "")
    start = span["start"] + F.length(span["found"]) - F.length(left)
    return F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("found"),
                    F.concat(span["before"], F.left(span["found"], F.length(span["found"]) - F.length(left))).alias("before"))


def score_graph(spans: DataFrame, rounds: int = 3, min_support: int = 3) -> DataFrame:
    """pattern, kind, found, seed, score: the edges of the pattern-instance graph after ``rounds``.

    Seeds score 1.  A pattern of a kind has confidence (sum of its instances' scores) / (instances + 1) and counts
    with at least ``min_support`` seeds; an unseen instance scores 1 - product of (1 - confidence) over its patterns."""
    seeds = spans.select(F.inline(F.concat("base", "secrets"))).select(
        F.explode("before").alias("pattern"), "kind", "found", F.lit(1).alias("seed"))
    unseen = spans.select(F.inline("candidates")).select(F.explode("before").alias("pattern"), "found") \
        .select("pattern", F.explode(F.array(*[F.when(_shape(k, F.col("found")), F.lit(n)) for n, k in enumerate(ALL_KINDS)]))
                .alias("kind"), "found", F.lit(0).alias("seed")).where("kind is not null")
    edges = written(seeds.unionByName(unseen).where("pattern not in ('words ', 'label ')").groupBy("pattern", "kind", "found")
                    .agg(F.max("seed").alias("seed")).withColumn("score", F.col("seed").cast("double")), "pii-edges")
    for _ in range(rounds):
        # small tables of their own, so that the joins can split the edges of a frequent pattern or instance
        patterns = written(_confidence(edges, min_support), "pii-patterns")
        scores = edges.where("seed = 0").join(patterns, ["pattern", "kind"]).groupBy("kind", "found") \
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("new"))
        scores = written(scores, "pii-scores")
        before, edges = edges, written(edges.join(scores, ["kind", "found"], "left").select(
            "pattern", "kind", "found", "seed",
            F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("new", F.lit(0.0))).alias("score")), "pii-edges")
        for table in (before, patterns, scores):
            forget(table)
    return edges


def _confidence(edges: DataFrame, min_support: int) -> DataFrame:
    return edges.groupBy("pattern", "kind").agg(
        (F.sum("score") / (F.count(F.lit(1)) + 1)).alias("confidence"), F.sum("seed").alias("seeds")) \
        .where(F.col("seeds") >= min_support).drop("seeds")


def discovered(edges: DataFrame, min_confidence: float = 0.7, min_support: int = 3) -> DataFrame:
    """found, kind: unseen instances that a pattern of at least ``min_confidence`` extracts; the best kind of each."""
    good = written(_confidence(edges, min_support).where(F.col("confidence") >= min_confidence), "pii-patterns")
    found = edges.where("seed = 0").join(good, ["pattern", "kind"]).groupBy("found").agg(
        F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return written(found, "pii-discovered")


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, rounds: int = 3, min_support: int = 3, min_confidence: float = 0.7) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_added per row of ``docs``.

    The counts of the base kinds and the hash are of the base spans; ``spans`` lists them, the n_secret secrets and the
    n_added discovered ones by start, then kind (base kinds, then secret).  Null texts are empty, ids are passed through (null or repeated), every row is judged for itself, an empty
    table gives no rows."""
    spans = find_spans(docs)
    found = discovered(score_graph(spans, rounds, min_support), min_confidence, min_support)
    # what lies inside a longer discovered span of its row is a part of it
    earlier = Window.partitionBy("row").orderBy("start", F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)
    added = spans.select("row", F.inline("candidates")).join(found, "found") \
        .withColumn("reach", F.max("end").over(earlier)).where("reach is null or reach < end").groupBy("row").agg(
            F.collect_list(F.struct("start", "kind", "end")).alias("added"))
    places = lambda spans: F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    base = places("base")
    plus = F.coalesce(F.col("added"), F.array().cast("array<struct<start:int,kind:int,end:int>>"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return spans.select("row", "doc_id", "base", "secrets").join(added, "row", "left").select(
        "doc_id", *[count(n).alias(f"n_{k}") for n, k in enumerate(KINDS)],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(base, places("secrets"), plus))).alias("spans"),
        F.size("secrets").cast("long").alias("n_secret"), F.size(plus).cast("long").alias("n_added"))
