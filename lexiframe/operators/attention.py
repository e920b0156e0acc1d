"""Attention tables: head/layer averaging, sub-token merging, top attended words,
residual normalisation, rollout, word importance and HTML highlighting.

Inputs are long tables:
  tokens    (sample_id, pos, token)                     ``[CLS]`` first, ``##`` continues a word
  attention (sample_id, layer, head, q, k, weight)      each (sample, layer, head, q) row sums to 1

Groups are samples (bounded by the model's sequence length), so windows and
per-sample arrays are keyed by ``sample_id`` and never hold more than one
sample's L x S x S cells.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import ENGLISH_STOP_WORDS, SPECIAL_TOKENS, SUBWORD_PREFIX
from ..functions.text import html_escape, strip_subword_prefix
from .ranking import top_k


# ----------------------------------------------------------------------------- averaging

def mean_attention(att: DataFrame, over: Sequence[str] = ("layer", "head"), at: Mapping[str, int] | None = None) -> DataFrame:
    """Mean weight over the axes ``over``, after fixing axes by ``at`` (``{"layer": 1}``).
    Output: sample_id, the axes that remain, q, k, weight.  Attention is dense, so the mean
    of means along the axes is the mean over all cells."""
    at = dict(at or {})
    for axis, i in at.items():
        att = att.where(F.col(axis) == i)
    kept = [axis for axis in ("layer", "head") if axis not in over and axis not in at]
    return att.groupBy("sample_id", *kept, "q", "k").agg(F.avg("weight").alias("weight"))


def compare_runs(a: DataFrame, b: DataFrame, names: tuple[str, str] = ("weight_a", "weight_b")) -> DataFrame:
    """Two attention maps over the same (sample_id, q, k) cells side by side, with difference."""
    x = a.select("sample_id", "q", "k", F.col("weight").alias(names[0]))
    y = b.select("sample_id", "q", "k", F.col("weight").alias(names[1]))
    out = x.join(y, ["sample_id", "q", "k"], "full")
    return out.withColumn("diff", F.col(names[1]) - F.col(names[0]))


# ----------------------------------------------------------------------------- sub-tokens

def word_ids(tokens: DataFrame, out: str = "word_id") -> DataFrame:
    """A new word starts at every token that does not begin with ``##``; a leading
    ``##`` piece opens a word of its own (id 0)."""
    w = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    starts = F.when(F.col("token").startswith(SUBWORD_PREFIX), 0).otherwise(1)
    return tokens.withColumn(out, F.sum(starts).over(w).cast("int"))


def merge_subwords(scored_tokens: DataFrame, score: str = "score") -> DataFrame:
    """``stack`` + ``##ing`` -> ``stacking`` with summed scores, in order.
    A word whose text is empty is dropped together with its score.
    Output: sample_id, word_id, word, score, first_pos."""
    t = word_ids(scored_tokens)
    g = t.groupBy("sample_id", "word_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), strip_subword_prefix("token").alias("piece"))))
        .alias("__p"), F.sum(score).alias("score"), F.min("pos").alias("first_pos"))
    g = g.select("sample_id", "word_id", F.array_join(F.transform("__p", lambda x: x["piece"]), "").alias("word"),
                 "score", "first_pos")
    return g.where(F.col("word") != "")


def top_attended_words(att: DataFrame, tokens: DataFrame, k: int = 10,
                       stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
                       special_tokens: Sequence[str] = SPECIAL_TOKENS, tie_digits: int | None = None) -> DataFrame:
    """Words most attended from the first position: row ``q=0`` of the layer- and
    head-averaged map without ``k=0``, sub-tokens merged, stop words and special
    tokens dropped, top ``k`` by score (stable: earlier word first on ties).
    Output: sample_id, rank, word, score."""
    row0 = mean_attention(att.where(F.col("q") == 0)).where(F.col("k") >= 1)
    toks = tokens.where(F.col("pos") >= 1)
    scored = toks.join(row0.select("sample_id", F.col("k").alias("pos"), F.col("weight").alias("score")),
                       ["sample_id", "pos"])
    words = merge_subwords(scored)
    words = words.where(~F.lower(F.col("word")).isin(list(stop_words)) & ~F.col("word").isin(list(special_tokens)))
    order_score = F.col("score") if tie_digits is None else F.round("score", tie_digits)
    ranked = top_k(words, ["sample_id"], [order_score.desc(), F.col("word_id").asc()], k, out="rank")
    return ranked.select("sample_id", F.col("rank").cast("int").alias("rank"), "word", "score")


# ----------------------------------------------------------------------------- rollout

def residual_normalize(att: DataFrame, add_residual: bool = True) -> DataFrame:
    """``(A + I)`` with each row divided by its sum, per head (before the head mean)."""
    if not add_residual:
        return att
    w = F.col("weight") + F.when(F.col("q") == F.col("k"), 1.0).otherwise(0.0)
    row = Window.partitionBy("sample_id", "layer", "head", "q")
    return att.withColumn("weight", w).withColumn("weight", F.col("weight") / F.sum("weight").over(row))


def joint_attention(att: DataFrame, add_residual: bool = True) -> DataFrame:
    """Residual-normalised, head-averaged map per layer: sample_id, layer, q, k, weight."""
    return (residual_normalize(att, add_residual).groupBy("sample_id", "layer", "q", "k")
            .agg(F.avg("weight").alias("weight")))


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and pass it to ``body`` as a lambda variable.

    Referencing an intermediate column from inside a lambda lets the optimizer
    inline (and re-evaluate) it for every element; binding it through a
    one-element ``transform`` keeps it computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def joint_rows(att: DataFrame, add_residual: bool = True) -> DataFrame:
    """The residual-normalised, head-averaged map as one array per attention row:
    sample_id, layer, q, row (array of S doubles, index = k).

    One aggregation per (sample, layer, q) — a group is that row's H x S cells —
    then higher-order functions: per-head row sums (+1 for the identity), the
    identity on the diagonal, the mean over heads.  No window sort and no
    per-cell aggregation.  Attention given as rows (column ``weights``: the array over k
    instead of k and weight) is normalised row by row and only its heads are grouped.
    """
    if "weights" in att.columns:
        return _joint_of_rows(att, add_residual)
    g = att.groupBy("sample_id", "layer", "q").agg(
        F.array_sort(F.collect_list(F.struct("head", "k", "weight"))).alias("__c"),
        (F.max("head") + 1).alias("__H"), (F.max("k") + 1).alias("__S"), F.count(F.lit(1)).alias("__n"))
    H, S = F.col("__H"), F.col("__S")
    eye = 1.0 if add_residual else 0.0

    def row_from(w):  # w: weights ordered by (head, k)
        if add_residual:
            rs_expr = F.transform(F.sequence(F.lit(0), H - 1), lambda h: F.aggregate(
                F.slice(w, h * S + 1, S), F.lit(0.0), lambda acc, x: acc + x) + F.lit(1.0))
        else:
            rs_expr = F.array_repeat(F.lit(1.0), H)

        def with_rs(rs):
            def cell(h, k):
                diag = F.when(F.col("q") == k, F.lit(eye)).otherwise(F.lit(0.0))
                return (F.element_at(w, h * S + k + 1) + diag) / F.element_at(rs, h + 1)
            return F.transform(F.sequence(F.lit(0), S - 1), lambda k: F.aggregate(
                F.sequence(F.lit(0), H - 1), F.lit(0.0), lambda acc, h: acc + cell(h, k)) / H)
        return _let(rs_expr, with_rs)

    row = _let(F.transform("__c", lambda x: x["weight"]), row_from)
    checked = F.when(F.col("__n") == H * S, row).otherwise(
        F.raise_error(F.lit("attention is not dense over heads x keys")))
    return g.select("sample_id", "layer", "q", checked.alias("row"))


def _joint_of_rows(att: DataFrame, add_residual: bool) -> DataFrame:
    def normal(w, total):
        return F.transform(w, lambda x, k: (x + F.when(k == F.col("q"), 1.0).otherwise(0.0)) / total)

    row = F.col("weights")
    if add_residual:
        row = _let(F.aggregate(row, F.lit(1.0), lambda acc, x: acc + x), lambda total: normal(F.col("weights"), total))
    heads = att.select("sample_id", "layer", "q", "head", row.alias("row")).groupBy("sample_id", "layer", "q").agg(
        F.array_sort(F.collect_list(F.struct("head", "row"))).alias("__h"))
    n, first = F.size("__h"), F.element_at("__h", 1)["row"]
    total = F.aggregate(F.slice("__h", 2, n), first, lambda acc, h: F.zip_with(acc, h["row"], lambda a, b: a + b))
    mean = F.transform(total, lambda x: x / n)
    ragged = F.exists("__h", lambda h: F.size(h["row"]) != F.size(first))
    checked = F.when(ragged, F.raise_error(F.lit("attention is not dense over heads x keys"))).otherwise(mean)
    return heads.select("sample_id", "layer", "q", checked.alias("row"))


def rollout(att: DataFrame, layers: str | int = "all", add_residual: bool = True, method: str = "arrays",
            n_layers: int | None = None) -> DataFrame:
    """Attention rollout, importance of every position for position 0.

    ``layers='all'``: row 0 of ``J[L-1] @ ... @ J[0]`` (the documented rollout);
    ``layers=1``: row 0 of ``J[0]`` only (what the original script computes); it reads
    nothing but row 0 of layer 0.  Only a row vector is carried, S^2 work per layer.

    ``method='arrays'`` (default): rows of J as arrays (:func:`joint_rows`), one more
    aggregation per sample (L x S row arrays, bounded by the model shape), then the
    vector-matrix products as higher-order functions.  Every grouping starts with
    ``sample_id``: no exchange when the table is already partitioned by it.
    ``method='blocks'``: for long sequences, see ``attention_blocks.rollout_blocks``.
    ``method='join'``: one join + sum step per layer on the long table; ``n_layers`` (with
    ``layers='all'``) makes each step filter a literal layer.
    Output: sample_id, k, score.
    """
    a = att if layers == "all" else att.where(F.col("layer") < int(layers))
    if layers != "all" and int(layers) == 1 and "weights" in att.columns:
        row0 = joint_rows(a.where(F.col("q") == 0), add_residual).select("sample_id", F.posexplode("row").alias("k", "score"))
        return row0.select("sample_id", F.col("k").cast("int").alias("k"), "score")
    if layers != "all" and int(layers) == 1:
        row0 = joint_attention(a.where(F.col("q") == 0), add_residual)
        return row0.select("sample_id", F.col("k").cast("int").alias("k"), F.col("weight").alias("score"))
    if method == "join":
        top = int(layers) if layers != "all" else n_layers
        if not top:
            raise ValueError("the join method needs n_layers")
        return _rollout_join(att, top, add_residual)
    if method == "blocks":
        from .attention_blocks import rollout_blocks
        return rollout_blocks(joint_rows(a, add_residual))
    rows = joint_rows(a, add_residual)
    per = rows.groupBy("sample_id").agg(
        F.array_sort(F.collect_list(F.struct("layer", "q", "row"))).alias("__r"),
        (F.max("layer") + 1).alias("__L"), F.count(F.lit(1)).alias("__n"), F.max(F.size("row")).alias("__S"))
    S, L = F.col("__S"), F.col("__L")

    def m(layer, j, k):
        return F.element_at(F.element_at(F.col("__r"), layer * S + j + 1)["row"], k + 1)

    start = F.element_at(F.col("__r"), (L - 1) * S + 1)["row"]
    steps = F.when(L >= 2, F.sequence(L - 2, F.lit(0), F.lit(-1))).otherwise(F.array().cast("array<int>"))
    vec = F.aggregate(
        steps, start,
        lambda v, layer: F.transform(
            F.sequence(F.lit(0), S - 1),
            lambda k: F.aggregate(F.sequence(F.lit(0), S - 1), F.lit(0.0),
                                  lambda acc, jj: acc + F.element_at(v, jj + 1) * m(layer, jj, k))))
    checked = F.when(F.col("__n") == L * S, vec).otherwise(
        F.raise_error(F.lit("attention is not a dense L x S x S tensor")))
    out = per.select("sample_id", F.posexplode(checked).alias("k", "score"))
    return out.select("sample_id", F.col("k").cast("int").alias("k"), "score")


def _rollout_join(att: DataFrame, n_layers: int, add_residual: bool) -> DataFrame:
    def layer(i: int, *only) -> DataFrame:
        cells = att.where(F.col("layer") == i)
        for cond in only:
            cells = cells.where(cond)
        return joint_attention(cells, add_residual)

    v = layer(n_layers - 1, F.col("q") == 0).select("sample_id", "k", F.col("weight").alias("v"))
    for i in range(n_layers - 2, -1, -1):
        m = layer(i).select("sample_id", F.col("q").alias("k"), F.col("k").alias("k2"), F.col("weight").alias("w"))
        v = v.join(m, ["sample_id", "k"]).groupBy("sample_id", F.col("k2").alias("k")).agg(
            F.sum(F.col("v") * F.col("w")).alias("v"))
    return v.select("sample_id", F.col("k").cast("int").alias("k"), F.col("v").alias("score"))


def rollout_words(scores: DataFrame, tokens: DataFrame) -> DataFrame:
    """Sub-tokens merged over all positions, then the first word dropped
    (no stop-word filter).  Output: sample_id, word_id, word, score."""
    scored = tokens.join(scores.select("sample_id", F.col("k").alias("pos"), "score"), ["sample_id", "pos"])
    words = merge_subwords(scored)
    first = Window.partitionBy("sample_id").orderBy("word_id")
    return (words.withColumn("__r", F.row_number().over(first)).where(F.col("__r") > 1)
            .select("sample_id", "word_id", "word", "score"))


def colour_values(words: DataFrame, score_digits: int | None = None) -> DataFrame:
    """Blue channel per word: ``int(255 * (1 - (s - min) / (max - min + 1e-9)))`` inside
    its sample (truncation).  ``score_digits`` rounds scores first so that words
    whose scores tie exactly in real arithmetic stay tied under float noise."""
    s = F.col("score") if score_digits is None else F.round("score", score_digits)
    w = Window.partitionBy("sample_id")
    lo, hi = F.min(s).over(w), F.max(s).over(w)
    norm = (s - lo) / (hi - lo + F.lit(1e-9))
    return words.withColumn("blue", (F.lit(255.0) * (F.lit(1.0) - norm)).cast("int"))


def highlight_html(words: DataFrame, score_digits: int | None = None) -> DataFrame:
    """One ``<p>`` per sample; each word a span coloured by :func:`colour_values`,
    joined in word order.  Output: sample_id, html."""
    spans = colour_values(words, score_digits).select("sample_id", "word_id", F.format_string(
        '<span style="background:rgb(0,0,%d);color:white"> %s </span>', F.col("blue"), html_escape("word")).alias("span"))
    g = spans.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("word_id", "span"))).alias("__s"))
    return g.select("sample_id", F.concat(F.lit("<p>"), F.array_join(F.transform("__s", lambda x: x["span"]), ""),
                                          F.lit("</p>")).alias("html"))
