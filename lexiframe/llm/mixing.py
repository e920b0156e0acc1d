"""Mixing sources to target weights by iterative proportional fitting.

Token masses are counted per (source, language, topic) cell with one aggregation.  The cells are raked to the target
marginals; a document is sampled with the probability that its cell's calibrated weight gives.  Values that the targets
do not name share one category, so the cells are bounded by the targets, whatever the corpus holds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, text_of

DIMENSIONS = ("source", "lang", "topic")
#: The category of values that no target names, nulls among them.
OTHER = "(other)"
SWEEPS = 40
#: Share of the tokens that the expected sample holds at least, whatever the rarest named value has.
LEAST_SHARE = 0.05
#: The mixture of the registered query: every source alike, less English, medium texts preferred.
TARGETS = {"source": {f"src{i}": 0.05 for i in range(20)},
           "lang": {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2},
           "topic": {"note": 0.1, "article": 0.6, "book": 0.3}}


def word_count(text):
    """Words between ASCII white space."""
    bare = F.btrim(text, F.lit(ASCII_SPACE))
    return F.when(F.length(bare) == 0, F.lit(0)).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def form_topic(n_words):
    """A coarse topic for tables without one: the form of the text by its length."""
    return F.when(n_words < 150, "note").when(n_words < 1500, "article").otherwise("book")


def rake(mass: np.ndarray, targets: list[np.ndarray], sweeps: int = SWEEPS) -> np.ndarray:
    """``mass`` (one axis per dimension) scaled to the marginal shares ``targets``, by ``sweeps`` rounds over the axes."""
    weight = mass / mass.sum()
    for _ in range(sweeps):
        for axis, target in enumerate(targets):
            now = weight.sum(axis=tuple(a for a in range(weight.ndim) if a != axis))
            factor = np.divide(target, now, out=np.zeros_like(now), where=now > 0)
            weight = weight * factor.reshape([-1 if a == axis else 1 for a in range(weight.ndim)])
    return weight


def marginal(named: dict, observed: dict) -> dict:
    """Target shares of the values that have tokens: OTHER keeps its observed share, the named ones divide the rest
    in their proportions (values without tokens give theirs up)."""
    total = sum(observed.values())
    rest = observed.get(OTHER, 0.0) / total
    present = {v: t for v, t in named.items() if observed.get(v, 0.0) > 0 and t > 0}
    scale = (1.0 - rest) / sum(present.values()) if present else 0.0
    out = {v: t * scale for v, t in present.items()}
    if rest > 0:
        out[OTHER] = rest if present else 1.0
    return out


def probabilities(cells: dict, weight: dict, least_share: float) -> dict:
    """cell -> probability: weight over token mass, scaled so that the largest is 1 and the sample has the marginals.

    Where that would keep under ``least_share`` of the tokens, the scale is the one that keeps this share with
    probabilities clipped at 1: cells that are too rare for their weight are kept whole and miss their target."""
    ratio = {c: weight[c] / m for c, m in cells.items()}
    top, floor = max(ratio.values()), least_share * sum(cells.values())
    if 1 / top >= floor:
        return {c: r / top for c, r in ratio.items()}
    order = sorted(ratio, key=lambda c: (-ratio[c], c))
    whole, rest = 0.0, sum(weight[c] for c in order)
    for c in order:
        scale = (floor - whole) / rest if rest > 0 else float("inf")
        if scale * ratio[c] <= 1:
            return {x: min(1.0, r * scale) for x, r in ratio.items()}
        whole, rest = whole + cells[c], rest - weight[c]
    return dict.fromkeys(ratio, 1.0)


def calibrate(docs: DataFrame, targets: dict = TARGETS, sweeps: int = SWEEPS, least_share: float = LEAST_SHARE) -> dict:
    """cell -> (weight, probability) from the token masses of ``docs`` (columns of DIMENSIONS and n_tokens).

    weight: the raked share of tokens; probability: see :func:`probabilities`; no document is needed twice."""
    cells = {tuple(r[d] for d in DIMENSIONS): float(r["m"]) for r in docs.groupBy(*DIMENSIONS).agg(
        F.sum("n_tokens").alias("m")).collect()}  # at most the product of the target sizes plus one
    cells = {c: m for c, m in cells.items() if m > 0}
    if not cells:
        return {}
    values, shares = [], []
    for axis, d in enumerate(DIMENSIONS):
        observed: dict = {}
        for c, m in sorted(cells.items()):
            observed[c[axis]] = observed.get(c[axis], 0.0) + m
        share = marginal(targets[d], observed)
        values.append(sorted(observed))
        shares.append(np.array([share.get(v, 0.0) for v in values[-1]]))
    mass = np.zeros([len(v) for v in values])
    for c, m in cells.items():
        mass[tuple(v.index(x) for v, x in zip(values, c))] = m
    weight = rake(mass, shares, sweeps)
    raked = {c: float(weight[tuple(v.index(x) for v, x in zip(values, c))]) for c in cells}
    likely = probabilities(cells, raked, least_share)
    return {c: (raked[c], likely[c]) for c in cells}


def mixture_summary(docs: DataFrame, targets: dict = TARGETS, topic=form_topic, sweeps: int = SWEEPS,
                    least_share: float = LEAST_SHARE) -> DataFrame:
    """dimension, value, n_tokens, target, expected, kept: the tokens of each value, the share that the targets ask for
    (null for OTHER), its share of the expected sample, and how much of it the sample keeps; and a row of all.

    A target that is missed (a value too rare for it) shows as the difference of the two shares."""
    marked = _celled(docs, targets, topic).select(*[F.col(f"__llm_{d}").alias(d) for d in DIMENSIONS],
                                                  F.col("__llm_n_tokens").alias("n_tokens"))
    cells = calibrate(marked, targets, sweeps, least_share)
    masses = {tuple(r[d] for d in DIMENSIONS): float(r["m"]) for r in marked.groupBy(*DIMENSIONS).agg(
        F.sum("n_tokens").alias("m")).collect()}
    kept = {c: masses[c] * p for c, (_, p) in cells.items()}
    total = sum(kept.values())
    rows = [("all", "", float(sum(masses[c] for c in cells)), None, 1.0 if total else None,
             total / sum(masses[c] for c in cells) if cells else None)]
    for axis, d in enumerate(DIMENSIONS):
        for value in sorted({c[axis] for c in cells}):
            own = [c for c in cells if c[axis] == value]
            mass, take = sum(masses[c] for c in own), sum(kept[c] for c in own)
            rows.append((d, value, mass, targets[d].get(value), take / total if total else None, take / mass))
    return docs.sparkSession.createDataFrame(
        rows, "dimension string, value string, n_tokens double, target double, expected double, kept double")


def _celled(docs: DataFrame, targets: dict, topic) -> DataFrame:
    """__llm_* columns: the category in each dimension, the tokens, a uniform number from the document id."""
    n = word_count(text_of())
    raw = {"source": F.col("source"), "lang": F.col("lang"), "topic": topic(F.col("__llm_n_tokens"))}
    out = docs.withColumn("__llm_n_tokens", n)
    for d in DIMENSIONS:
        out = out.withColumn(f"__llm_{d}", F.when(raw[d].cast("string").isin(list(targets[d])), raw[d].cast("string"))
                             .otherwise(F.lit(OTHER)))
    return out


def uniform_number(seed: int, id_col: str = "doc_id"):
    """A number in [0, 1) from the id (null: as the text 'null'): equal ids are sampled together."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}")))
    return F.conv(F.substring(key, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_probability(docs: DataFrame, targets: dict = TARGETS, topic=form_topic, sweeps: int = SWEEPS,
                     seed: int = 42, least_share: float = LEAST_SHARE) -> DataFrame:
    """``docs`` with __llm_source, __llm_lang, __llm_topic, __llm_n_tokens, __llm_weight (of the cell),
    __llm_probability, __llm_sampled.  A text without words has probability 1 where its cell has no tokens at all."""
    marked = _celled(docs, targets, topic)
    cells = calibrate(marked.select(*[F.col(f"__llm_{d}").alias(d) for d in DIMENSIONS],
                                    F.col("__llm_n_tokens").alias("n_tokens")), targets, sweeps, least_share)
    table = docs.sparkSession.createDataFrame(
        [(*c, float(w), float(p)) for c, (w, p) in cells.items()],
        ", ".join(f"__llm_{d} string" for d in DIMENSIONS) + ", __llm_weight double, __llm_probability double")
    joined = marked.join(F.broadcast(table), [f"__llm_{d}" for d in DIMENSIONS], "left")  # bounded by the targets
    return joined.withColumn("__llm_weight", F.coalesce("__llm_weight", F.lit(0.0))) \
        .withColumn("__llm_probability", F.coalesce("__llm_probability", F.lit(1.0))) \
        .withColumn("__llm_sampled", uniform_number(seed) < F.col("__llm_probability"))


def mixing_report(docs: DataFrame, targets: dict = TARGETS, topic=form_topic, sweeps: int = SWEEPS,
                  seed: int = 42, least_share: float = LEAST_SHARE) -> DataFrame:
    """doc_id, source, lang, topic (categories of the mixture), n_tokens, weight, probability, sampled per row.

    Null or unnamed sources and languages are the category OTHER, null texts have no tokens; rows that repeat an id
    are sampled together; an empty table gives no rows."""
    out = with_probability(docs, targets, topic, sweeps, seed, least_share)
    return out.select("doc_id", *[F.col(f"__llm_{d}").alias(d) for d in DIMENSIONS],
                      *[F.col(f"__llm_{c}").alias(c) for c in ("n_tokens", "weight", "probability", "sampled")])


def sample_mixture(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mixture samples."""
    out = with_probability(docs, **options)
    return out.where("__llm_sampled").select(*[F.col(f"`{c}`") for c in docs.columns])


def oracle_sql(targets: dict = TARGETS, sweeps: int = SWEEPS, seed: int = 42, least_share: float = LEAST_SHARE) -> str:
    """DuckDB SQL of :func:`mixing_report`: the raking rounds as nested window sums over the cell table, the scale from
    running sums over the cells by descending ratio."""
    category = {d: f"CASE WHEN {c} IN ({', '.join(repr(v) for v in targets[d])}) THEN {c} ELSE '{OTHER}' END"
                for d, c in (("source", "source"), ("lang", "lang"))}
    trimmed = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    sql = f"""WITH w AS (SELECT doc_id, {category['source']} AS source, {category['lang']} AS lang,
  CAST(CASE WHEN {trimmed} = '' THEN 0 ELSE len(string_split_regex({trimmed}, '[\\x20\\x09-\\x0D]+')) END AS BIGINT) AS n_tokens
  FROM documents),
d AS (SELECT *, CASE WHEN n_tokens < 150 THEN 'note' WHEN n_tokens < 1500 THEN 'article' ELSE 'book' END AS topic FROM w),
c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS DOUBLE) AS mass FROM d GROUP BY ALL HAVING sum(n_tokens) > 0)"""
    for d in DIMENSIONS:
        named = ", ".join(f"('{v}', CAST({t!r} AS DOUBLE))" for v, t in targets[d].items())
        sql += f""",
o_{d} AS (SELECT {d}, sum(mass) AS m FROM c GROUP BY {d}),
r_{d} AS (SELECT coalesce(sum(m) FILTER (WHERE {d} = '{OTHER}'), 0) / sum(m) AS rest FROM o_{d}),
t_{d} AS (SELECT {d}, CASE WHEN {d} = '{OTHER}' THEN (SELECT rest FROM r_{d}) ELSE t * (1 - (SELECT rest FROM r_{d}))
  / sum(t) OVER () END AS share FROM o_{d} LEFT JOIN (VALUES {named}) AS v(name, t) ON name = {d})"""
    inner = f"""SELECT source, lang, topic, mass, t_source.share AS share_source, t_lang.share AS share_lang,
  t_topic.share AS share_topic, mass / sum(mass) OVER () AS w FROM c JOIN t_source USING (source)
  JOIN t_lang USING (lang) JOIN t_topic USING (topic)"""
    keep = "source, lang, topic, mass, share_source, share_lang, share_topic"
    for _ in range(sweeps):
        for d in DIMENSIONS:
            inner = f"SELECT {keep}, w * share_{d} / sum(w) OVER (PARTITION BY {d}) AS w FROM ({inner})"
    return sql + f""",
k AS (SELECT source, lang, topic, w, mass, w / mass AS r, max(w / mass) OVER () AS top, {least_share!r} * sum(mass) OVER () AS at_least,
  row_number() OVER (ORDER BY w / mass DESC, source, lang, topic) AS i,
  coalesce(sum(mass) OVER (ORDER BY w / mass DESC, source, lang, topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole,
  sum(w) OVER (ORDER BY w / mass DESC, source, lang, topic ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM ({inner})),
s AS (SELECT min(i) FILTER (WHERE (at_least - whole) / rest * r <= 1) AS first_i FROM k),
sc AS (SELECT (at_least - whole) / rest AS scale FROM k, s WHERE i = first_i),
p AS (SELECT source, lang, topic, w, CASE WHEN 1 / top >= at_least THEN r / top ELSE least(1, r * coalesce(scale, 1e300)) END AS probability
      FROM k LEFT JOIN sc ON TRUE)
SELECT doc_id, source, lang, topic, n_tokens, coalesce(w, 0) AS weight, coalesce(probability, 1) AS probability,
  CAST('0x' || substr(md5(doc_id || ':{seed}'), 1, 12) AS BIGINT) / 281474976710656.0 < coalesce(probability, 1) AS sampled
FROM d LEFT JOIN p USING (source, lang, topic)"""
