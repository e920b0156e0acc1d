"""Query catalog: one Spark plan per inventory ID (``queries``) and, where plain
SQL can say the same, its DuckDB twin (``oracle_sql``).

Every query reads whole driver tables (or inputs Spark derives from them);
doubles are rounded to 6 places on both sides (10 for densities) so that
different summation orders compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.fixed import NA_TOKENS
from ..functions.text import contains_text, strip_subword_prefix, strip_ws, word_count, html_escape
from ..functions.text import words as text_words
from ..functions.vectors import argmax
from ..operators import attention as att_ops
from ..operators import metrics, model, outliers, profile, scoring, split, stats, training, trainlog
from ..session import reliable_checkpoint, scratch_path
from ..sources import files, html_files, observed, order, tables
from . import sql as S

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


# Rounding for comparison: through a decimal with four digits more, half away from zero.
# The extra digits absorb float summation order; the value itself is not changed.
EXTRA_DIGITS = 4


def _decimal_rounds(sql: str) -> str:
    """Rewrite every ``round(E, d)`` of the oracle text as :func:`_round` does it.
    Upper-case ``ROUND`` is left alone."""
    out, i = [], 0
    while True:
        j = sql.find("round(", i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        k, depth, comma = j + len("round("), 1, None
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        inner = _decimal_rounds(sql[j + len("round("):comma])
        digits = int(sql[comma + 1:k - 1])
        out.append(f"CAST(ROUND(TRY_CAST({inner} AS DECIMAL(38, {digits + EXTRA_DIGITS})), {digits}) AS DOUBLE)")
        i = k


def query(name: str, oracle: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if oracle is not None:
            _SQL[name] = _decimal_rounds(oracle)
        return fn
    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def rnd(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (both sides of the oracle compare do the same)."""
    return df.select(*[_round(F.col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                       else F.col(f.name) for f in df.schema.fields])


def _round(c, digits: int):
    return F.round(c.try_cast(f"decimal(38,{digits + EXTRA_DIGITS})"), digits).cast("double")


def _t(spark, sf, name):
    return tables.load(spark, sf, name)


def labelled(spark, sf) -> DataFrame:
    """Multi-label sentences from ``documents``: row_id, sentence, label, lang (lazy, so a
    query reads only the columns it uses)."""
    return tables.multilabel_sentences(_t(spark, sf, "documents"), keep=["lang"])


def sentences(spark, sf) -> DataFrame:
    """row_id, label, lang, n_words, materialised once: several branches of a plan read it
    (label statistics, the rows to trim) and the text pass must not be repeated."""
    return reliable_checkpoint(labelled(spark, sf).select("row_id", "label", "lang", word_count("sentence").alias("n_words")))


def exploded(spark, sf, s: DataFrame | None = None) -> DataFrame:
    return profile.explode_labels(sentences(spark, sf) if s is None else s, "label")


def tokens(spark, sf) -> DataFrame:
    return tables.benchmark_tokens(_t(spark, sf, "benchmark"))


def attention(spark, sf, run="eval") -> DataFrame:
    # generated inside sample_id partitions; later per-sample steps add no shuffle
    return tables.synthetic_attention(tokens(spark, sf), run=run)


def attention_rows(spark, sf, t: DataFrame) -> DataFrame:
    """The same attention, a row per query position (nothing is exploded into cells)."""
    return tables.synthetic_attention_rows(t)


def trainer_log(spark, sf) -> DataFrame:
    return tables.events_trainer_log(_t(spark, sf, "events"))


# ============================================================================ flagship
FLAGSHIP_SQL = f"""
WITH {S.SENTENCES}, {S.EXPLODED},
st AS (SELECT label_item, avg(n_words) AS m, stddev_pop(n_words) AS sd FROM ex GROUP BY label_item),
kept AS (SELECT ex.label_item, ex.n_words FROM ex JOIN st USING (label_item)
         WHERE abs((ex.n_words - st.m) / nullif(st.sd, 0)) <= 3)
SELECT label_item AS label, count(*) AS n_rows, round(avg(n_words), 6) AS mean_words,
       round(quantile_cont(n_words, 0.25), 6) AS q25_words, round(quantile_cont(n_words, 0.5), 6) AS q50_words,
       round(quantile_cont(n_words, 0.75), 6) AS q75_words, min(n_words) AS min_words, max(n_words) AS max_words
FROM kept GROUP BY label_item
"""


@query("o_f1_trimmed_label_profile", FLAGSHIP_SQL)
def trimmed_label_profile(spark, sf):
    """Word-count profile per label after per-label z-score trimming (flagship)."""
    kept = outliers.trim_by_label(exploded(spark, sf), "label_item", "n_words")
    x = F.percentile("n_words", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    m = kept.groupBy("label_item").agg(
        F.count(F.lit(1)).cast("long").alias("n_rows"), F.avg("n_words").alias("mean_words"), x.alias("q"),
        F.min("n_words").alias("min_words"), F.max("n_words").alias("max_words"))
    return rnd(m.select(F.col("label_item").alias("label"), "n_rows", "mean_words", F.col("q")[0].alias("q25_words"),
                        F.col("q")[1].alias("q50_words"), F.col("q")[2].alias("q75_words"), "min_words", "max_words"))


@query("o_s3_read_text_lines", f"""
SELECT * FROM (
  SELECT conv_id, turn, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS line_no,
         {S.strip('unnest(ls)')} AS sentence
  FROM (SELECT conv_id, turn, regexp_split_to_array(text, '{S.LINES}') AS ls FROM conversations))
WHERE sentence <> ''
""")
def read_text_lines(spark, sf):
    return files.lines_to_sentences(_t(spark, sf, "conversations"), "text", keep=["conv_id", "turn"])


@query("o_s3_text_files", f"""
WITH raw AS (SELECT conv_id, turn, regexp_split_to_array(text, '\\r\\n|\\n|\\r') AS ls FROM conversations),
l AS (SELECT conv_id, turn, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS n FROM raw),
numbered AS (SELECT line, CAST(row_number() OVER (ORDER BY conv_id, turn, n) - 1 AS BIGINT) AS line_id FROM l),
p AS (SELECT line_id, regexp_split_to_array(line, '{S.LINES}') AS ps FROM numbered)
SELECT * FROM (SELECT line_id, CAST(unnest(generate_series(0, len(ps) - 1)) AS INTEGER) AS piece,
                      {S.strip('unnest(ps)')} AS sentence FROM p) WHERE sentence <> ''
""")
def read_text_files(spark, sf):
    """Texts in conversation order written to several files, read as lines that are numbered over all files."""
    path = scratch_path(spark, "text-lines")
    conv = _t(spark, sf, "conversations").select("conv_id", "turn", "text")
    conv.repartitionByRange(5, "conv_id", "turn").sortWithinPartitions("conv_id", "turn").select("text").write.text(path)
    return files.read_text_lines(spark, path).select("line_id", F.col("piece").cast("int").alias("piece"), "sentence")


# ============================================================================ profiling
NA_SQL = S.sql_list(NA_TOKENS)


@query("o_s1_read_csv", f"""
SELECT CASE WHEN text IN ({NA_SQL}) THEN NULL ELSE text END AS sentence, concat_ws(',', lang, source) AS label FROM documents
""")
def read_csv(spark, sf):
    """Sentences written as CSV in the shared scratch folder and read back (O-S1, O-S2, O-S7)."""
    path = scratch_path(spark, "sentences-csv")
    files.write_csv(labelled(spark, sf).select("sentence", "label"), path)
    return files.read_sentences_csv(spark, path).select("sentence", "label")


@query("o_s6_history_csv", f"""
WITH {S.LOG} SELECT step, round(max(loss), 6) AS train_loss, round(max(eval_f1), 6) AS val_f1 FROM log GROUP BY run, step
""")
def history_csv(spark, sf):
    """The exporter's history as CSV, read with the history reader."""
    path = scratch_path(spark, "history-csv")
    flat = trainlog.flatten_log(trainer_log(spark, sf), id_cols=["run"])
    files.write_csv(trainlog.history_bridge(flat).select("step", "train_loss", "val_f1"), path)
    return rnd(files.read_history_csv(spark, path))


@query("o_s8_jsonl", "SELECT conv_id, turn, role, text FROM conversations")
def jsonl_round_trip(spark, sf):
    path = scratch_path(spark, "jsonl")
    table = _t(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    files.write_jsonl(table, path)
    return spark.read.schema(table.schema).json(path)


@query("o_p1_head", "SELECT doc_id, text, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT 5")
def head(spark, sf):
    return profile.head(_t(spark, sf, "documents"), 5, ["doc_id"])


@query("o_p2_column_info", """
SELECT CAST(col_pos AS INTEGER) AS col_pos, col_name, col_type, non_null FROM (
  SELECT 0 AS col_pos, 'l_orderkey' AS col_name, lower(typeof(any_value(l_orderkey))) AS col_type, count(l_orderkey) AS non_null FROM lineitem
  UNION ALL SELECT 1, 'l_partkey', lower(typeof(any_value(l_partkey))), count(l_partkey) FROM lineitem
  UNION ALL SELECT 2, 'l_suppkey', lower(typeof(any_value(l_suppkey))), count(l_suppkey) FROM lineitem
  UNION ALL SELECT 3, 'l_linenumber', lower(typeof(any_value(l_linenumber))), count(l_linenumber) FROM lineitem
  UNION ALL SELECT 4, 'l_quantity', lower(typeof(any_value(l_quantity))), count(l_quantity) FROM lineitem
  UNION ALL SELECT 5, 'l_extendedprice', lower(typeof(any_value(l_extendedprice))), count(l_extendedprice) FROM lineitem
  UNION ALL SELECT 6, 'l_discount', lower(typeof(any_value(l_discount))), count(l_discount) FROM lineitem
  UNION ALL SELECT 7, 'l_tax', lower(typeof(any_value(l_tax))), count(l_tax) FROM lineitem
  UNION ALL SELECT 8, 'l_returnflag', lower(typeof(any_value(l_returnflag))), count(l_returnflag) FROM lineitem
  UNION ALL SELECT 9, 'l_linestatus', lower(typeof(any_value(l_linestatus))), count(l_linestatus) FROM lineitem
  UNION ALL SELECT 10, 'l_shipdate', lower(typeof(any_value(l_shipdate))), count(l_shipdate) FROM lineitem)
""")
def column_info(spark, sf):
    return profile.column_info(_t(spark, sf, "lineitem"))


def _summary_sql(table: str, numeric: list[str], categorical: list[str], datetimes: list[str] = ()) -> str:
    parts = []
    for c in numeric + list(datetimes):
        x = f"(epoch_us({c}) / 86400e6)" if c in datetimes else f"CAST({c} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS col_name, count({x}) AS n, CAST(NULL AS BIGINT) AS n_unique, CAST(NULL AS VARCHAR) AS top, "
            f"CAST(NULL AS BIGINT) AS freq, round(avg({x}), 6) AS mean, round(stddev_samp({x}), 6) AS std, "
            f"round(min({x}), 6) AS min_v, round(quantile_cont({x}, 0.25), 6) AS p25, "
            f"round(quantile_cont({x}, 0.5), 6) AS p50, round(quantile_cont({x}, 0.75), 6) AS p75, "
            f"round(max({x}), 6) AS max_v FROM {table}")
    for c in categorical:
        parts.append(
            f"SELECT '{c}', (SELECT count({c}) FROM {table}), (SELECT count(DISTINCT {c}) FROM {table}), "
            f"(SELECT v FROM (SELECT CAST({c} AS VARCHAR) AS v, count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL "
            f"GROUP BY 1) ORDER BY cnt DESC, v LIMIT 1), "
            f"(SELECT max(cnt) FROM (SELECT count(*) AS cnt FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})), "
            f"NULL, NULL, NULL, NULL, NULL, NULL, NULL")
    return "\nUNION ALL\n".join(parts)


@query("o_p3_summary_documents", _summary_sql("documents", ["doc_id", "n_chars"], ["text", "lang", "source"]))
def summary_documents(spark, sf):
    return rnd(profile.summary(_t(spark, sf, "documents")))


@query("o_p3_summary_lineitem", _summary_sql(
    "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax"], ["l_returnflag", "l_linestatus"], ["l_shipdate"]))
def summary_lineitem(spark, sf):
    return rnd(profile.summary(_t(spark, sf, "lineitem")))


@query("o_p4_null_counts", """
SELECT CAST(col_pos AS INTEGER) AS col_pos, col_name, n_null FROM (
  SELECT 0 AS col_pos, 'doc_id' AS col_name, count_if(doc_id IS NULL) AS n_null FROM documents
  UNION ALL SELECT 1, 'text', count_if(text IS NULL) FROM documents
  UNION ALL SELECT 2, 'lang', count_if(lang IS NULL) FROM documents
  UNION ALL SELECT 3, 'source', count_if(source IS NULL) FROM documents
  UNION ALL SELECT 4, 'n_chars', count_if(n_chars IS NULL) FROM documents)
""")
def null_counts(spark, sf):
    return profile.null_counts(_t(spark, sf, "documents"))


@query("o_p5_duplicate_report", """
SELECT CAST(sum(c) AS BIGINT) AS n_dup_rows, count(*) AS n_dup_groups
FROM (SELECT text, count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)
""")
def duplicate_report(spark, sf):
    return profile.duplicate_report(_t(spark, sf, "documents"), ["text"])


@query("o_f3_duplicate_rows", """
SELECT doc_id, text, lang, source, n_chars, count(*) OVER (PARTITION BY text) AS dup_count FROM documents
QUALIFY count(*) OVER (PARTITION BY text) > 1
""")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(_t(spark, sf, "documents"), ["text"]).select(
        "doc_id", "text", "lang", "source", "n_chars", "dup_count")


# ============================================================================ scalar functions
@query("o_c1_split_labels", f"""
WITH {S.SENTENCES}, {S.EXPLODED} SELECT row_id, label_pos, label_item FROM ex
""")
def split_labels(spark, sf):
    s = tables.multilabel_sentences(_t(spark, sf, "documents"))
    return profile.explode_labels(s, "label").select("row_id", F.col("label_pos").cast("int"), "label_item")


def conversation_items(spark, sf) -> DataFrame:
    return tables.conversation_label_items(_t(spark, sf, "conversations"))


@query("o_c2_labels_per_row", """
SELECT conv_id, turn, CAST(len(string_split(text, ',')) AS BIGINT) AS num_labels FROM conversations
""")
def labels_per_row(spark, sf):
    """Length of the list that a comma-joined column holds (the turns' texts are such lists)."""
    from ..functions.text import split_labels as split_col
    return _t(spark, sf, "conversations").select("conv_id", "turn", F.size(split_col("text")).cast("long").alias("num_labels"))


def _hist_sql(src: str, value: str, bins: int) -> str:
    return f"""
r0 AS (SELECT CAST(min({value}) AS DOUBLE) AS a, CAST(max({value}) AS DOUBLE) AS b FROM {src} WHERE {value} IS NOT NULL),
r AS (SELECT CASE WHEN a = b THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = b THEN b + 0.5 ELSE b END AS hi FROM r0),
e AS (SELECT lo, hi, (hi - lo) / {bins}.0 AS step, {bins}.0 / (hi - lo) AS norm FROM r),
x AS (SELECT CAST({value} AS DOUBLE) AS v, lo, hi, step, norm FROM {src}, e WHERE {value} IS NOT NULL),
i0 AS (SELECT *, least(CAST(trunc((v - lo) * norm) AS INTEGER), {bins - 1}) AS b0 FROM x),
i1 AS (SELECT *, CASE WHEN v < (CASE WHEN b0 >= {bins} THEN hi ELSE b0 * step + lo END) THEN b0 - 1 ELSE b0 END AS b1 FROM i0),
i2 AS (SELECT CASE WHEN v >= (CASE WHEN b1 + 1 >= {bins} THEN hi ELSE (b1 + 1) * step + lo END) AND b1 <> {bins - 1}
             THEN b1 + 1 ELSE b1 END AS bin FROM i1),
c AS (SELECT bin, count(*) AS n FROM i2 GROUP BY bin),
sp AS (SELECT CAST(g.bin AS INTEGER) AS bin, CASE WHEN g.bin >= {bins} THEN hi ELSE g.bin * step + lo END AS lo_edge,
              CASE WHEN g.bin + 1 >= {bins} THEN hi ELSE (g.bin + 1) * step + lo END AS hi_edge
       FROM e, (SELECT unnest(generate_series(0, {bins - 1})) AS bin) g)
SELECT sp.bin, round(lo_edge, 6) AS lo_edge, round(hi_edge, 6) AS hi_edge, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM sp LEFT JOIN c ON sp.bin = c.bin
"""


@query("o_a18_labels_per_row_hist", f"""
WITH lc AS (SELECT len(string_split(text, ',')) AS num_labels FROM conversations),
{_hist_sql('lc', 'num_labels', 10)}
""")
def labels_per_row_hist(spark, sf):
    return rnd(stats.histogram(labels_per_row(spark, sf), "num_labels", 10))


@query("o_c3_word_count", f"SELECT doc_id AS row_id, {S.word_count('text')} AS n_words FROM documents")
def word_counts(spark, sf):
    return _t(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), word_count("text").alias("n_words"))


@query("o_c4_explode_labels", f"""
WITH {S.SENTENCES}, {S.EXPLODED} SELECT row_id, label_pos, label_item, n_words FROM ex
""")
def explode_labels(spark, sf):
    e = exploded(spark, sf, labelled(spark, sf).withColumn("n_words", word_count("sentence")))
    return e.select("row_id", F.col("label_pos").cast("int"), "label_item", "n_words")


@query("o_c6_strip", f"SELECT conv_id, turn, {S.strip('text')} AS stripped FROM conversations")
def strip_text(spark, sf):
    return _t(spark, sf, "conversations").select("conv_id", "turn", strip_ws("text").alias("stripped"))


@query("o_c7_subword_pieces", f"""
WITH {S.TOKENS}
SELECT sample_id, pos, token, CASE WHEN starts_with(token, '##') THEN substring(token, 3) ELSE token END AS piece,
       lower(token) AS token_lower FROM tokens
""")
def subword_pieces(spark, sf):
    return tokens(spark, sf).select("sample_id", "pos", "token", strip_subword_prefix("token").alias("piece"),
                                    F.lower("token").alias("token_lower"))


@query("o_c9_html_escape", """
SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
       '"', '&quot;'), '''', '&#x27;') AS escaped FROM pages
""")
def escape_pages(spark, sf):
    return _t(spark, sf, "pages").select("page_id", html_escape("html").alias("escaped"))


# ============================================================================ filters
@query("o_f2_label_tests", f"""
WITH {S.SENTENCES}
SELECT row_id, label, NOT contains(label, 'src1') AS lacks_substring,
       list_contains(string_split(label, ','), 'src1') AS has_exact FROM sent
""")
def label_tests(spark, sf):
    from ..functions.text import split_labels as split_col
    s = labelled(spark, sf)
    return s.select("row_id", "label", (~contains_text("label", "src1")).alias("lacks_substring"),
                    F.array_contains(split_col("label"), "src1").alias("has_exact"))


@query("o_w1_global_zscore", f"""
WITH {S.SENTENCES}
SELECT row_id, n_words, round((n_words - avg(n_words) OVER ()) / nullif(stddev_pop(n_words) OVER (), 0), 6) AS z FROM sent
""")
def global_zscore(spark, sf):
    s = sentences(spark, sf).select("row_id", "n_words")
    return rnd(stats.zscore(s, "n_words"))


@query("o_f1_global_trim", f"""
WITH {S.SENTENCES}, z AS (SELECT row_id, n_words,
  (n_words - avg(n_words) OVER ()) / nullif(stddev_pop(n_words) OVER (), 0) AS z FROM sent)
SELECT row_id, n_words FROM z WHERE abs(z) <= 3
""")
def global_trim(spark, sf):
    return outliers.trim_outliers(sentences(spark, sf).select("row_id", "n_words"), "n_words")


@query("o_w2_label_zscore", f"""
WITH {S.SENTENCES}, {S.EXPLODED}
SELECT row_id, label_item, n_words, round((n_words - avg(n_words) OVER (PARTITION BY label_item))
       / nullif(stddev_pop(n_words) OVER (PARTITION BY label_item), 0), 6) AS z FROM ex
""")
def label_zscore(spark, sf):
    e = exploded(spark, sf).select("row_id", "label_item", "n_words")
    return rnd(stats.zscore(e, "n_words", ["label_item"]))


@query("o_f4_stopword_filter", f"""
WITH {S.TOKENS}, t1 AS (SELECT sample_id, pos, token, 1.0 AS score FROM tokens), {S.merge_words('t1', 'mw')}
SELECT sample_id, word_id, word FROM mw
WHERE lower(word) NOT IN ({S.STOP_WORDS}) AND word NOT IN ('[CLS]', '[SEP]', '[PAD]')
""")
def stopword_filter(spark, sf):
    from ..functions.fixed import ENGLISH_STOP_WORDS, SPECIAL_TOKENS
    w = att_ops.merge_subwords(tokens(spark, sf).withColumn("score", F.lit(1.0)))
    return w.where(~F.lower("word").isin(list(ENGLISH_STOP_WORDS)) & ~F.col("word").isin(list(SPECIAL_TOKENS))) \
        .select("sample_id", "word_id", "word")


# ============================================================================ aggregations
@query("o_a1_label_counts", f"""
WITH {S.SENTENCES}, {S.EXPLODED},
g AS (SELECT label_item AS label, count(*) AS n, min(row_id * 1000000 + label_pos) AS f FROM ex GROUP BY label_item)
SELECT label, n, row_number() OVER (ORDER BY f) AS seen_order FROM g
""")
def label_counts(spark, sf):
    return profile.label_counts(labelled(spark, sf), "label", "row_id")


def _trimmed_union(spark, sf, s: DataFrame | None = None) -> DataFrame:
    """Literal union: labels de, en, es trimmed inside their label, fr kept whole,
    every other label (the sources) lost."""
    e = exploded(spark, sf, s)
    return outliers.trim_by_label(e, "label_item", "n_words", trim=("de", "en", "es"), keep=("fr",))


TRIMMED_SQL = f"""{S.SENTENCES}, {S.EXPLODED},
st AS (SELECT label_item, avg(n_words) AS m, stddev_pop(n_words) AS sd FROM ex
       WHERE label_item IN ('de', 'en', 'es') GROUP BY label_item),
kept AS (SELECT ex.* FROM ex LEFT JOIN st USING (label_item)
         WHERE label_item = 'fr' OR (label_item IN ('de', 'en', 'es') AND abs((n_words - m) / nullif(sd, 0)) <= 3))"""


@query("o_u1_trimmed_union", f"WITH {TRIMMED_SQL} SELECT row_id, label_item, n_words FROM kept")
def trimmed_union(spark, sf):
    return _trimmed_union(spark, sf).select("row_id", "label_item", "n_words")


@query("o_c5_export_columns", f"WITH {TRIMMED_SQL} SELECT sentence, label FROM kept")
def export_columns(spark, sf):
    # two passes over the text (label statistics, export), but no text in a shuffle or checkpoint
    s = labelled(spark, sf).withColumn("n_words", word_count("sentence"))
    return _trimmed_union(spark, sf, s).select("sentence", "label")


@query("o_a2_value_counts", f"""
WITH {TRIMMED_SQL} SELECT label_item, count(*) AS n FROM kept GROUP BY label_item
""")
def value_counts(spark, sf):
    return profile.value_counts(_trimmed_union(spark, sf), "label_item")


@query("o_u2_mixed_union", f"""
WITH {S.SENTENCES}, z AS (SELECT *, (n_words - avg(n_words) OVER ()) / nullif(stddev_pop(n_words) OVER (), 0) AS z FROM sent)
SELECT row_id, label, n_words FROM z WHERE NOT contains(label, 'src1')
UNION ALL SELECT row_id, label, n_words FROM z WHERE abs(z) <= 3
""")
def mixed_union(spark, sf):
    return outliers.union_mixed(sentences(spark, sf).select("row_id", "label", "n_words"), "label", "n_words",
                                needle="src1")


@query("o_a3_cooccurrence", f"""
WITH {S.ROLES},
e AS (SELECT row_id, unnest(string_split(label, ',')) AS l FROM roles),
m AS (SELECT row_id, l, count(*) AS c FROM e GROUP BY row_id, l),
p AS (SELECT a.l AS label_a, b.l AS label_b, sum(a.c * b.c) AS n FROM m a JOIN m b ON a.row_id = b.row_id GROUP BY a.l, b.l),
l AS (SELECT DISTINCT l FROM e)
SELECT x.l AS label_a, y.l AS label_b, CAST(coalesce(n, 0) AS BIGINT) AS n FROM l x CROSS JOIN l y
LEFT JOIN p ON label_a = x.l AND label_b = y.l
""")
def cooccurrence(spark, sf):
    return profile.dense_cooccurrence(profile.cooccurrence_items(conversation_items(spark, sf), "row_id", "label_item"))


@query("o_a4_mean_length", f"""
WITH {TRIMMED_SQL}
SELECT round((SELECT avg(n_words) FROM sent), 6) AS mean_before, round((SELECT avg(n_words) FROM kept), 6) AS mean_after
""")
def mean_length(spark, sf):
    s = sentences(spark, sf)
    before = s.agg(F.avg("n_words").alias("mean_before"))
    after = _trimmed_union(spark, sf, s).agg(F.avg("n_words").alias("mean_after"))
    return rnd(before.select("mean_before", after.select("mean_after").scalar().alias("mean_after")))


@query("o_a5_length_moments", f"""
WITH {S.SENTENCES}, {S.EXPLODED}
SELECT label_item, count(*) AS n, round(avg(n_words), 6) AS mean, round(stddev_pop(n_words), 6) AS std_pop,
       round(stddev_samp(n_words), 6) AS std_samp FROM ex GROUP BY label_item
""")
def length_moments(spark, sf):
    m = stats.group_moments(exploded(spark, sf), "n_words", ["label_item"])
    return rnd(m.select("label_item", F.col("n").cast("long"), "mean", "std_pop", "std_samp"))


@query("o_a6_length_histogram", f"WITH {S.SENTENCES}, {_hist_sql('sent', 'n_words', 20)}")
def length_histogram(spark, sf):
    return rnd(stats.histogram(sentences(spark, sf), "n_words", 20))


def _kde_sql(ctes: str, factor: str = "1") -> str:
    """Density oracle over the CTE d (label, x); ``factor`` scales it by columns of gx."""
    return f"""
WITH {ctes},
ks AS (SELECT label, count(*) AS n, stddev_samp(x) * pow(count(*), -0.2) AS bw, min(x) AS a, max(x) AS b
       FROM d GROUP BY label HAVING count(*) >= 2 AND stddev_samp(x) > 0),
g AS (SELECT label, n, bw, a, b, a - 3 * bw AS g0, b + 3 * bw AS g1, unnest(generate_series(0, 199)) AS grid_idx FROM ks),
gx AS (SELECT label, n, bw, a, b, grid_idx, CASE WHEN grid_idx = 199 THEN g1 ELSE grid_idx * ((g1 - g0) / 199.0) + g0 END AS gxv FROM g),
w AS (SELECT label, x, count(*) AS c FROM d GROUP BY label, x)
SELECT gx.label, CAST(gx.grid_idx AS INTEGER) AS grid_idx, round(gx.gxv, 6) AS x,
       round({factor} * sum(w.c * exp(-0.5 * ((gx.gxv - w.x) / gx.bw) * ((gx.gxv - w.x) / gx.bw))) / (gx.n * gx.bw * sqrt(2 * pi())), 10)
       AS density
FROM gx JOIN w ON gx.label = w.label GROUP BY gx.label, gx.grid_idx, gx.gxv, gx.n, gx.bw, gx.a, gx.b
"""


KDE_SQL = _kde_sql(f"d AS (SELECT lang AS label, CAST({S.word_count('text')} AS DOUBLE) AS x FROM documents)")


def _kde_rows(k: DataFrame) -> DataFrame:
    return k.select("label", "grid_idx", _round(F.col("x"), 6).alias("x"), _round(F.col("density"), 10).alias("density"))


@query("o_a7_length_kde", KDE_SQL)
def length_kde(spark, sf):
    d = sentences(spark, sf).select(F.col("lang").alias("label"), F.col("n_words").alias("x"))
    return _kde_rows(stats.kde(d, "x", ["label"]))


@query("o_a7_length_curve", _kde_sql(f"d AS (SELECT lang AS label, CAST({S.word_count('text')} AS DOUBLE) AS x FROM documents)",
                                     "gx.n * (gx.b - gx.a) / 20"))
def length_curve(spark, sf):
    """The curve over a count histogram of 20 bins per label."""
    d = sentences(spark, sf).select(F.col("lang").alias("label"), F.col("n_words").alias("x"))
    return _kde_rows(stats.kde(d, "x", ["label"], scale="count", bins=20))


@query("o_a7_kde_trimmed", _kde_sql(f"{TRIMMED_SQL}, d AS (SELECT label_item AS label, CAST(n_words AS DOUBLE) AS x FROM kept)"))
def kde_trimmed(spark, sf):
    kept = _trimmed_union(spark, sf).select(F.col("label_item").alias("label"), F.col("n_words").alias("x"))
    return _kde_rows(stats.kde(kept, "x", ["label"]))


@query("o_a7_price_density", """
WITH s AS (SELECT l_returnflag AS flag, count(*) AS n, stddev_samp(l_extendedprice) * pow(count(*), -0.2) AS bw,
                  min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem GROUP BY 1),
g AS (SELECT flag, n, bw, a - 3 * bw AS g0, b + 3 * bw AS g1, ceil((b - a + 6 * bw) / bw * 64 / 199) AS per FROM s),
st AS (SELECT *, (g1 - g0) / (per * 199) AS step FROM g),
p AS (SELECT flag, (l_extendedprice - g0) / step AS pl FROM lineitem JOIN st ON flag = l_returnflag),
node AS (SELECT flag, node, sum(w) AS w FROM (
  SELECT flag, floor(pl) AS node, floor(pl) + 1 - pl AS w FROM p UNION ALL SELECT flag, floor(pl) + 1, pl - floor(pl) FROM p)
  GROUP BY flag, node),
grid AS (SELECT st.*, unnest(generate_series(0, 199)) AS grid_idx FROM st),
hit AS (SELECT flag, grid_idx, w, (grid_idx * per * step - node * step) / bw AS u FROM node JOIN grid USING (flag)),
dens AS (SELECT flag, grid_idx, sum(w * exp(-0.5 * u * u)) AS s FROM hit WHERE abs(u) <= 6 GROUP BY flag, grid_idx)
SELECT flag, CAST(grid_idx AS INTEGER) AS grid_idx,
       round(CASE WHEN grid_idx = 199 THEN g1 ELSE grid_idx * ((g1 - g0) / 199.0) + g0 END, 6) AS x,
       round(coalesce(s, 0) / (n * bw * sqrt(2 * pi())), 12) AS density
FROM grid LEFT JOIN dens USING (flag, grid_idx)
""")
def price_density(spark, sf):
    """Density of a continuous column by a few classes, from bins (the bins in SQL; the plain sum in pytest)."""
    li = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("v"))
    return stats.kde_binned(li, "v", ["flag"]).select(
        "flag", "grid_idx", _round(F.col("x"), 6).alias("x"), _round(F.col("density"), 12).alias("density"))


@query("o_a6_hist_trimmed", f"WITH {TRIMMED_SQL}, {_hist_sql('kept', 'n_words', 20)}")
def hist_trimmed(spark, sf):
    return rnd(stats.histogram(_trimmed_union(spark, sf), "n_words", 20))


def _box_sql(ctes: str, src: str) -> str:
    return f"""
WITH {ctes},
q AS (SELECT label_item, quantile_cont(n_words, 0.25) AS q1, quantile_cont(n_words, 0.5) AS med,
             quantile_cont(n_words, 0.75) AS q3 FROM {src} GROUP BY label_item),
j AS (SELECT {src}.label_item, n_words, q1, med, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lov, q3 + 1.5 * (q3 - q1) AS hiv
      FROM {src} JOIN q USING (label_item)),
a AS (SELECT label_item, count(*) AS n, avg(n_words) AS mean, any_value(q1) AS q1, any_value(med) AS med,
             any_value(q3) AS q3, any_value(iqr) AS iqr,
             max(CASE WHEN n_words <= hiv THEN n_words END) AS hi, min(CASE WHEN n_words >= lov THEN n_words END) AS lo,
             count_if(n_words < lov OR n_words > hiv) AS n_fliers FROM j GROUP BY label_item)
SELECT label_item, n, round(mean, 6) AS mean, round(q1, 6) AS q1, round(med, 6) AS med, round(q3, 6) AS q3,
       round(iqr, 6) AS iqr,
       round(CASE WHEN lo IS NULL OR lo > q1 THEN q1 ELSE lo END, 6) AS whislo,
       round(CASE WHEN hi IS NULL OR hi < q3 THEN q3 ELSE hi END, 6) AS whishi, n_fliers FROM a
"""


@query("o_a8_box_stats", _box_sql(f"{S.SENTENCES}, {S.EXPLODED}", "ex"))
def box_stats(spark, sf):
    return _box_rows(exploded(spark, sf))


@query("o_a8_box_trimmed", _box_sql(TRIMMED_SQL, "kept"))
def box_trimmed(spark, sf):
    return _box_rows(_trimmed_union(spark, sf))


@query("o_a8_price_box", """
WITH q AS (SELECT l_returnflag AS flag, count(*) AS n, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.25) AS q1,
                  quantile_cont(l_extendedprice, 0.5) AS med, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT flag, any_value(n) AS n, round(any_value(mean), 4) AS mean, round(any_value(q1), 6) AS q1, round(any_value(med), 6) AS med,
       round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr,
       round(least(min(l_extendedprice) FILTER (WHERE l_extendedprice >= lo), any_value(q1)), 6) AS whislo,
       round(greatest(max(l_extendedprice) FILTER (WHERE l_extendedprice <= hi), any_value(q3)), 6) AS whishi,
       count(*) FILTER (WHERE l_extendedprice < lo OR l_extendedprice > hi) AS n_fliers
FROM lineitem JOIN f ON flag = l_returnflag GROUP BY flag
""")
def price_box(spark, sf):
    """Box statistics of a continuous column by a few classes: quartiles by selection, no class gathered."""
    li = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").cast("double").alias("x"))
    return rnd(stats.box_stats(li, "x", ["flag"]).withColumn("mean", _round(F.col("mean"), 4)))


def _box_rows(e: DataFrame) -> DataFrame:
    b = stats.box_stats(e, "n_words", ["label_item"])
    return rnd(b.select("label_item", F.col("n").cast("long"), "mean", "q1", "med", "q3", "iqr", "whislo", "whishi",
                        F.col("n_fliers").cast("long")))


# ============================================================================ metrics
def predictions(spark, sf, bias_en: int = 0) -> DataFrame:
    return tables.letter_predictions(_t(spark, sf, "documents"), bias_en)


@query("o_c13_argmax_predictions", f"WITH {S.letter_scores()}, {S.PRED} SELECT row_id, y_true, y_pred FROM pred")
def argmax_predictions(spark, sf):
    return predictions(spark, sf)


@query("o_a9_confusion_matrix", f"""
WITH {S.letter_scores()}, {S.PRED},
l AS (SELECT y_true AS l FROM pred UNION SELECT y_pred FROM pred),
c AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL)
SELECT a.l AS y_true, b.l AS y_pred, CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM l a CROSS JOIN l b LEFT JOIN c ON c.y_true = a.l AND c.y_pred = b.l
""")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predictions(spark, sf))


def _class_sql(src: str, sfx: str = "") -> str:
    return f"""
l{sfx} AS (SELECT y_true AS label FROM {src} UNION SELECT y_pred FROM {src}),
ct{sfx} AS (SELECT l{sfx}.label,
         (SELECT count(*) FROM {src} WHERE y_true = l{sfx}.label AND y_pred = l{sfx}.label) AS tp,
         (SELECT count(*) FROM {src} WHERE y_true = l{sfx}.label) AS support,
         (SELECT count(*) FROM {src} WHERE y_pred = l{sfx}.label) AS predicted FROM l{sfx}),
pr{sfx} AS (SELECT label, support, predicted, tp, coalesce(tp / nullif(predicted, 0), 0) AS precision,
              coalesce(tp / nullif(support, 0), 0) AS recall FROM ct{sfx}),
rep{sfx} AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr{sfx})"""


@query("o_u3_report_with_overall", f"""
WITH {S.letter_scores()}, {S.PRED}, {_class_sql('pred')}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
       CAST(support AS BIGINT) AS support FROM rep
UNION ALL
SELECT 'Overall', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
       round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM rep
UNION ALL SELECT name, 0, 0, 0, 0 FROM (VALUES ('de'), ('en'), ('es'), ('fr'), ('it')) AS v(name)
WHERE name NOT IN (SELECT label FROM rep)
""")
def report_with_overall(spark, sf):
    """All label names have a row, also one that occurs on neither side ("it")."""
    return rnd(metrics.report_with_overall(predictions(spark, sf), labels=("de", "en", "es", "fr", "it")))


EVAL_SELECT = """
SELECT round(sum(tp) / sum(support), 6) AS accuracy,
       round(sum(precision * support) / sum(support), 6) AS precision,
       round(sum(recall * support) / sum(support), 6) AS recall,
       round(sum(f1 * support) / sum(support), 6) AS f1,
       round(CASE WHEN sqrt((sum(support) ^ 2 - sum(predicted * predicted)) * (sum(support) ^ 2 - sum(support * support))) = 0
             THEN 0 ELSE (sum(tp) * sum(support) - sum(support * predicted)) /
             sqrt((sum(support) ^ 2 - sum(predicted * predicted)) * (sum(support) ^ 2 - sum(support * support))) END, 6) AS mcc,
       round((sum(tp) * sum(support) - sum(support * predicted)) /
             nullif(sum(support) ^ 2 - sum(support * predicted), 0), 6) AS kappa
FROM rep"""


@query("o_a10_metrics", f"WITH {S.letter_scores()}, {S.PRED}, {_class_sql('pred')} {EVAL_SELECT}")
def eval_metrics(spark, sf):
    return rnd(metrics.evaluate(predictions(spark, sf)))


def _epoch_predictions(spark, sf) -> DataFrame:
    """Three candidates (epochs): English score biased by 2, 1, 0; one scan, biases exploded."""
    lg = tables.letter_logits(_t(spark, sf, "documents")).select("y_true", "logits", F.explode(
        F.array(*[F.lit(e) for e in (1, 2, 3)])).alias("epoch"))
    en = [c for c, _ in tables.SCORE_LETTERS].index("en")
    biased = F.transform("logits", lambda x, i: x + F.when(i == en, 3 - F.col("epoch")).otherwise(F.lit(0)))
    classes = F.array(*[F.lit(c) for c, _ in tables.SCORE_LETTERS])
    return lg.select("epoch", "y_true", F.element_at(classes, argmax(biased) + 1).alias("y_pred"))


def _epoch_sql(final: str) -> str:
    parts = []
    for e in (1, 2, 3):
        parts.append(f"{S.letter_scores(3 - e, f'lg{e}')}, "
                     f"p{e} AS (SELECT row_id, y_true, {S.ARGMAX} AS y_pred FROM lg{e}), {_class_sql(f'p{e}', str(e))}")
    union = " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM rep{e}" for e in (1, 2, 3))
    grouped = EVAL_SELECT.replace("SELECT round", "SELECT epoch, round", 1) + " GROUP BY epoch"
    return "WITH " + ", ".join(parts) + f", rep AS ({union}), m AS ({grouped}) {final}"


@query("o_m5_epoch_metrics", _epoch_sql("SELECT * FROM m"))
def epoch_metrics(spark, sf):
    return rnd(metrics.evaluate(_epoch_predictions(spark, sf), group=["epoch"]))


@query("o_m6_best_epoch", _epoch_sql("SELECT epoch, f1 FROM m ORDER BY f1 DESC, epoch LIMIT 1"))
def best_epoch(spark, sf):
    m = metrics.evaluate(_epoch_predictions(spark, sf), group=["epoch"])
    best = m.agg(F.max_by(F.struct("epoch", "f1"), F.struct(F.round("f1", 12), -F.col("epoch"))).alias("b"))
    return rnd(best.select(F.col("b.epoch").alias("epoch"), F.col("b.f1").alias("f1")))


# ============================================================================ attention
ATT = f"{S.TOKENS}, {S.attention('att')}"


@query("o_w4_word_ids", f"""
WITH {S.TOKENS}
SELECT sample_id, pos, token, CAST(sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END)
       OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS word_id
FROM tokens
""")
def word_ids(spark, sf):
    return att_ops.word_ids(tokens(spark, sf))


@query("o_a15_attention_map", f"""
WITH {ATT} SELECT sample_id, q, k, round(avg(weight), 6) AS weight FROM att GROUP BY sample_id, q, k
""")
def attention_map(spark, sf):
    return rnd(att_ops.mean_attention(attention(spark, sf)))


@query("o_t1_attention_layer_head", f"""
WITH {ATT} SELECT sample_id, q, k, round(weight, 6) AS weight FROM att WHERE layer = 1 AND head = 0
""")
def attention_layer_head(spark, sf):
    return rnd(att_ops.mean_attention(attention(spark, sf), at={"layer": 1, "head": 0}))


@query("o_a15_attention_heads", f"""
WITH {ATT} SELECT sample_id, head, q, k, round(avg(weight), 6) AS weight FROM att GROUP BY sample_id, head, q, k
""")
def attention_heads(spark, sf):
    return rnd(att_ops.mean_attention(attention(spark, sf), over=("layer",)))


@query("o_j5_side_by_side", f"""
WITH {ATT}, {S.attention('drop', 'dropout')},
a AS (SELECT sample_id, q, k, avg(weight) AS wa FROM att GROUP BY ALL),
b AS (SELECT sample_id, q, k, avg(weight) AS wb FROM drop GROUP BY ALL)
SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(a.q, b.q) AS q, coalesce(a.k, b.k) AS k,
       round(wa, 6) AS weight_eval, round(wb, 6) AS weight_dropout, round(wb - wa, 6) AS diff
FROM a FULL OUTER JOIN b ON a.sample_id = b.sample_id AND a.q = b.q AND a.k = b.k
""")
def side_by_side(spark, sf):
    a = att_ops.mean_attention(attention(spark, sf, "eval"))
    b = att_ops.mean_attention(attention(spark, sf, "dropout"))
    return rnd(att_ops.compare_runs(a, b, ("weight_eval", "weight_dropout")))


ROW0_SQL = "row0 AS (SELECT sample_id, k AS pos, avg(weight) AS score FROM att WHERE q = 0 GROUP BY sample_id, k)"


@query("o_a16_merge_subwords", f"""
WITH {ATT}, {ROW0_SQL}, st AS (SELECT t.sample_id, t.pos, t.token, r.score FROM tokens t JOIN row0 r USING (sample_id, pos)),
{S.merge_words('st', 'mw')}
SELECT sample_id, word_id, word, round(score, 6) AS score, first_pos FROM mw
""")
def merge_subwords(spark, sf):
    row0 = att_ops.mean_attention(attention(spark, sf).where(F.col("q") == 0))
    scored = tokens(spark, sf).join(row0.select("sample_id", F.col("k").alias("pos"), F.col("weight").alias("score")),
                                    ["sample_id", "pos"])
    return rnd(att_ops.merge_subwords(scored))


@query("o_w6_top_attended", f"""
WITH {ATT}, {ROW0_SQL},
st AS (SELECT t.sample_id, t.pos, t.token, r.score FROM tokens t JOIN row0 r USING (sample_id, pos) WHERE t.pos >= 1),
{S.merge_words('st', 'mw')},
f AS (SELECT * FROM mw WHERE lower(word) NOT IN ({S.STOP_WORDS}) AND word NOT IN ('[CLS]', '[SEP]', '[PAD]')),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ROUND(score, 9) DESC, word_id) AS rank FROM f)
SELECT sample_id, CAST(rank AS INTEGER) AS rank, word, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def top_attended(spark, sf):
    return rnd(att_ops.top_attended_words(attention(spark, sf), tokens(spark, sf), k=10, tie_digits=9))


RESID_SQL = """
rn AS (SELECT sample_id, layer, head, q, k, weight + CASE WHEN q = k THEN 1.0 ELSE 0.0 END AS w FROM att),
rn2 AS (SELECT *, w / sum(w) OVER (PARTITION BY sample_id, layer, head, q) AS wn FROM rn),
j AS (SELECT sample_id, layer, q, k, avg(wn) AS w FROM rn2 GROUP BY sample_id, layer, q, k)"""


@query("o_t3_residual_normalize", f"""
WITH {ATT}, {RESID_SQL} SELECT sample_id, layer, q, k, round(w, 6) AS weight FROM j
""")
def residual_normalize(spark, sf):
    return rnd(att_ops.joint_attention(attention(spark, sf)).select("sample_id", "layer", "q", "k", "weight"))


ROLLOUT_SQL = f"""{ATT}, {RESID_SQL},
v2 AS (SELECT sample_id, k, w AS v FROM j WHERE layer = 2 AND q = 0),
v1 AS (SELECT j.sample_id, j.k, sum(v2.v * j.w) AS v FROM v2 JOIN j ON j.sample_id = v2.sample_id AND j.layer = 1
       AND j.q = v2.k GROUP BY j.sample_id, j.k),
v0 AS (SELECT j.sample_id, j.k, sum(v1.v * j.w) AS v FROM v1 JOIN j ON j.sample_id = v1.sample_id AND j.layer = 0
       AND j.q = v1.k GROUP BY j.sample_id, j.k)"""


@query("o_t4_rollout", f"WITH {ROLLOUT_SQL} SELECT sample_id, k, round(v, 6) AS score FROM v0")
def rollout_all(spark, sf):
    return rnd(att_ops.rollout(attention_rows(spark, sf, tokens(spark, sf)), layers="all"))


@query("o_t4_rollout_first_layer", f"""
WITH {ATT}, {RESID_SQL} SELECT sample_id, k, round(w, 6) AS score FROM j WHERE layer = 0 AND q = 0
""")
def rollout_first_layer(spark, sf):
    return rnd(att_ops.rollout(attention(spark, sf), layers=1))


@query("o_t4_rollout_blocks", f"WITH {ROLLOUT_SQL} SELECT sample_id, k, round(v, 6) AS score FROM v0")
def rollout_blocks(spark, sf):
    """The rollout for long sequences: maps as blocks, products of vector blocks summed by key."""
    return rnd(att_ops.rollout(attention_rows(spark, sf, tokens(spark, sf)), method="blocks"))


@query("o_j4_rollout_join", f"WITH {ROLLOUT_SQL} SELECT sample_id, k, round(v, 6) AS score FROM v0")
def rollout_join(spark, sf):
    return rnd(att_ops.rollout(attention(spark, sf), layers="all", method="join", n_layers=3))


@query("o_j2_positional_zip", f"""
WITH {ROLLOUT_SQL} SELECT t.sample_id, t.pos, t.token, round(v0.v, 6) AS score
FROM tokens t JOIN v0 ON v0.sample_id = t.sample_id AND v0.k = t.pos
""")
def positional_zip(spark, sf):
    t = reliable_checkpoint(tokens(spark, sf))
    r = att_ops.rollout(attention_rows(spark, sf, t))
    return rnd(t.join(r.select("sample_id", F.col("k").alias("pos"), "score"), ["sample_id", "pos"]))


RWORDS_SQL = f"""{ROLLOUT_SQL},
st AS (SELECT t.sample_id, t.pos, t.token, v0.v AS score FROM tokens t JOIN v0 ON v0.sample_id = t.sample_id AND v0.k = t.pos),
{S.merge_words('st', 'mw')},
rw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY word_id) AS r FROM mw) WHERE r > 1)"""


def _rollout_words(spark, sf):
    t = reliable_checkpoint(tokens(spark, sf))
    return att_ops.rollout_words(att_ops.rollout(attention_rows(spark, sf, t)), t)


@query("o_t5_rollout_words", f"WITH {RWORDS_SQL} SELECT sample_id, word_id, word, round(score, 6) AS score FROM rw")
def rollout_words(spark, sf):
    return rnd(_rollout_words(spark, sf))


COLOR_SQL = f"""{RWORDS_SQL},
rq AS (SELECT sample_id, word_id, word, round(score, 12) AS s FROM rw),
cw AS (SELECT sample_id, word_id, word, CAST(trunc(255.0 * (1.0 - (s - min(s) OVER (PARTITION BY sample_id))
         / (max(s) OVER (PARTITION BY sample_id) - min(s) OVER (PARTITION BY sample_id) + 1e-9))) AS INTEGER) AS blue
       FROM rq)"""


@query("o_c10_colour_scale", f"WITH {COLOR_SQL} SELECT sample_id, word_id, word, blue FROM cw")
def colour_scale(spark, sf):
    return att_ops.colour_values(_rollout_words(spark, sf), score_digits=12).select("sample_id", "word_id", "word", "blue")


@query("o_t6_highlight", f"""
WITH {COLOR_SQL}
SELECT sample_id, '<p>' || string_agg('<span style="background:rgb(0,0,' || blue || ');color:white"> ' ||
       replace(replace(replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
       || ' </span>', '' ORDER BY word_id) || '</p>' AS html
FROM cw GROUP BY sample_id
""")
def highlight(spark, sf):
    return att_ops.highlight_html(_rollout_words(spark, sf), score_digits=12)


@query("o_s9_html_file", f"""
WITH {COLOR_SQL}
SELECT '<p>' || string_agg('<span style="background:rgb(0,0,' || blue || ');color:white"> ' ||
       replace(replace(replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')
       || ' </span>', '' ORDER BY word_id) || '</p>' AS html
FROM cw GROUP BY sample_id
""")
def html_file(spark, sf):
    path = scratch_path(spark, "html")
    files.write_html(att_ops.highlight_html(_rollout_words(spark, sf), score_digits=12), path)
    return spark.read.text(path).withColumnRenamed("value", "html")


@query("o_s9_html_samples", f"""
WITH {COLOR_SQL}
SELECT sample_id, '<p>' || string_agg('<span style="background:rgb(0,0,' || blue || ');color:white"> ' ||
       replace(replace(replace(replace(replace(word, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '\'\'', '&#x27;')
       || ' </span>', '' ORDER BY word_id) || '</p>' AS html
FROM cw GROUP BY sample_id
""")
def html_samples(spark, sf):
    """One HTML file per sample, named by it; read back with the sample from the name."""
    path = scratch_path(spark, "html-files")
    html_files.write_html_files(att_ops.highlight_html(_rollout_words(spark, sf), score_digits=12), path)
    return html_files.read_html_files(spark, path).select(F.col("sample").cast("long").alias("sample_id"), "html")


# ============================================================================ training log
@query("o_w5_log_ordinals", f"WITH {S.LOG} SELECT run, log_pos, step FROM log")
def log_ordinals(spark, sf):
    return trainer_log(spark, sf).select("run", "log_pos", "step")


NUMBERED = "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_id FROM documents"


@query("o_w5_file_lines", NUMBERED)
def file_lines(spark, sf):
    """``documents`` written in id order to several text files of JSON lines, numbered in file order when read."""
    path = scratch_path(spark, "numbered-lines")
    docs = _t(spark, sf, "documents").select("doc_id", "text")
    docs.repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id").select(F.to_json(F.struct("doc_id", "text")).alias("value")) \
        .write.text(path)
    lines = order.numbered_scan(spark.read.text(path))
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), "row_id")


@query("o_w5_row_index", NUMBERED)
def row_index(spark, sf):
    """``documents`` written in id order to several Parquet files, numbered by their row index when read."""
    path = scratch_path(spark, "numbered-rows")
    _t(spark, sf, "documents").select("doc_id", "lang").repartitionByRange(7, "doc_id").sortWithinPartitions("doc_id") \
        .write.parquet(path)
    return order.read_numbered_parquet(spark, path).select("doc_id", "row_id")


@query("o_l1_flatten_log", f"""
WITH {S.LOG} SELECT run, log_pos, step, round(eval_accuracy, 6) AS eval_accuracy, round(eval_f1, 6) AS eval_f1,
       round(eval_loss, 6) AS eval_loss, round(loss, 6) AS loss FROM log WHERE step IS NOT NULL
""")
def flatten_log(spark, sf):
    return rnd(trainlog.flatten_log(trainer_log(spark, sf), id_cols=["run", "log_pos"]))


def _log_json(log: DataFrame) -> DataFrame:
    """The records of :func:`trainer_log` as JSON texts in which a missing value is a missing key; every third one has a
    boolean ``best``, and ``note`` is a number in even and a text in odd steps."""
    fields = ["run", "step", "epoch", "loss", "eval_loss", "eval_f1", "eval_accuracy"]
    best = F.when(F.col("log_pos") % 3 == 0, F.col("log_pos") % 2 == 0).alias("best")
    even, odd = (F.to_json(F.struct(*fields, best, note.alias("note"))) for note in (
        F.col("step"), F.concat(F.lit("step "), F.col("step").cast("string"))))
    return log.select("run", "log_pos", F.when(F.col("step") % 2 == 0, even).otherwise(odd).alias("json"))


@query("o_s5_trainer_log", f"""
WITH {S.LOG} SELECT run, step, CASE WHEN log_pos % 3 = 0 THEN log_pos % 2 = 0 END AS best, round(eval_accuracy, 6) AS eval_accuracy,
       round(eval_f1, 6) AS eval_f1, round(eval_loss, 6) AS eval_loss, round(loss, 6) AS loss,
       CASE WHEN step % 2 = 0 THEN '' ELSE 'step ' END || step AS note FROM log
""")
def read_trainer_log(spark, sf):
    """Nested logs of all runs written, read back as VARIANT, flattened: keys and types found by one aggregation."""
    path = scratch_path(spark, "trainer-log")
    files.write_trainer_log(_log_json(trainer_log(spark, sf)), path)
    return rnd(trainlog.flatten_log(files.read_trainer_log(spark, path, lines=True), id_cols=["run"]))


@query("o_s5_log_keys", f"""
WITH {S.LOG}, k AS (
  SELECT unnest(['run', 'step', 'epoch', 'loss', 'eval_loss', 'eval_f1', 'eval_accuracy', 'best', 'note']) AS key,
         unnest([run IS NOT NULL, step IS NOT NULL, epoch IS NOT NULL, loss IS NOT NULL, eval_loss IS NOT NULL, eval_f1 IS NOT NULL,
                 eval_accuracy IS NOT NULL, log_pos % 3 = 0, TRUE]) AS has FROM log)
SELECT key, CASE WHEN key IN ('run', 'step') THEN 'BIGINT' WHEN key = 'best' THEN 'BOOLEAN' WHEN key = 'note' THEN 'VARIANT'
                 ELSE 'NUMBER' END AS kind, TRUE AS numeric, count(*) AS n FROM k WHERE has GROUP BY key
""")
def log_keys(spark, sf):
    """Keys, types and counts of the nested log records; decimal and double are one kind here."""
    records = _log_json(trainer_log(spark, sf)).select(F.parse_json("json").alias("record"))
    kind = F.when(F.col("kind").rlike("^(DECIMAL|DOUBLE)"), "NUMBER").otherwise(F.col("kind"))
    return files.log_keys(records).withColumn("kind", kind)


@query("o_f6_log_filters", f"""
WITH {S.LOG} SELECT run, count_if(loss IS NOT NULL AND eval_loss IS NULL) AS n_train,
       count_if(eval_loss IS NOT NULL) AS n_eval FROM log GROUP BY run
""")
def log_filters(spark, sf):
    lg = trainer_log(spark, sf)
    return lg.groupBy("run").agg(
        F.count_if(F.col("loss").isNotNull() & F.col("eval_loss").isNull()).cast("long").alias("n_train"),
        F.count_if(F.col("eval_loss").isNotNull()).cast("long").alias("n_eval"))


@query("o_a17_export_row_count", f"WITH {S.LOG} SELECT count(*) AS n_rows FROM log WHERE step IS NOT NULL")
def export_row_count(spark, sf):
    return trainlog.export_row_count(trainlog.flatten_log(trainer_log(spark, sf), id_cols=["run", "log_pos"]))


@query("o_a17_observed_export", f"""
WITH {S.LOG}, f AS (SELECT * FROM log WHERE step IS NOT NULL),
c AS (SELECT count(*) AS n, count_if(loss IS NULL) AS loss, count_if(eval_loss IS NULL) AS eval_loss,
             count_if(eval_f1 IS NULL) AS eval_f1, count_if(eval_accuracy IS NULL) AS eval_accuracy FROM f)
SELECT unnest(['run', 'step', 'eval_accuracy', 'eval_f1', 'eval_loss', 'loss']) AS column, n AS n_rows,
       unnest([0, 0, eval_accuracy, eval_f1, eval_loss, loss]) AS n_null FROM c
""")
def observed_export(spark, sf):
    """The history is written as CSV; rows and nulls per column are observed on the way."""
    flat = trainlog.flatten_log(trainer_log(spark, sf), id_cols=["run"])
    path = scratch_path(spark, "history-observed")
    return observed.write_observed(flat, lambda df: files.write_csv(df, path), required=("run", "step"))


@query("o_l3_history_bridge", f"""
WITH {S.LOG} SELECT run, step, round(max(eval_accuracy), 6) AS eval_accuracy, round(max(eval_loss), 6) AS eval_loss,
       round(max(loss), 6) AS train_loss, round(max(eval_f1), 6) AS val_f1 FROM log GROUP BY run, step
""")
def history_bridge(spark, sf):
    flat = trainlog.flatten_log(trainer_log(spark, sf), id_cols=["run"])
    return rnd(trainlog.history_bridge(flat, keys=("run", "step")))


@query("o_j3_curve_alignment", f"""
WITH {S.LOG},
tr AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step, log_pos) AS epoch, loss FROM log
       WHERE loss IS NOT NULL AND eval_loss IS NULL),
evl AS (SELECT run, row_number() OVER (PARTITION BY run ORDER BY step, log_pos) AS epoch, eval_loss, eval_accuracy
        FROM log WHERE eval_loss IS NOT NULL)
SELECT coalesce(tr.run, evl.run) AS run, CAST(coalesce(tr.epoch, evl.epoch) AS BIGINT) AS epoch,
       round(tr.loss, 6) AS train_loss, round(evl.eval_loss, 6) AS eval_loss, round(evl.eval_accuracy, 6) AS eval_accuracy
FROM tr FULL OUTER JOIN evl ON tr.run = evl.run AND tr.epoch = evl.epoch
""")
def curve_alignment(spark, sf):
    return rnd(trainlog.training_curves(trainer_log(spark, sf)))


@query("o_w7_best_checkpoint", f"""
WITH {S.LOG}, r AS (SELECT run, step, eval_f1, row_number() OVER (PARTITION BY run ORDER BY eval_f1 DESC, step) AS rk
                    FROM log WHERE eval_f1 IS NOT NULL)
SELECT run, step, round(eval_f1, 6) AS eval_f1 FROM r WHERE rk = 1
""")
def best_checkpoint(spark, sf):
    ev = trainer_log(spark, sf).where(F.col("eval_loss").isNotNull()).select("run", "step", "eval_f1")
    return rnd(trainlog.best_checkpoint(ev, "eval_f1", ["run"], "step"))


# ============================================================================ classes, split, encoding, scoring
@query("o_j1_label_lookup", """
SELECT doc_id AS row_id, lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_code FROM documents
""")
def label_lookup(spark, sf):
    s = tables.single_label_sentences(_t(spark, sf, "documents")).select("row_id", "label")
    return model.encode_labels(model.label_index(s), s).select("row_id", "label", "label_code")


@query("o_o5_class_order", """
SELECT lang AS label, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_code
FROM (SELECT DISTINCT lang FROM documents)
""")
def class_order(spark, sf):
    return model.label_index(tables.single_label_sentences(_t(spark, sf, "documents")))


SPLIT_SQL = """
c AS (SELECT lang, count(*) AS cnt FROM documents GROUP BY lang),
t AS (SELECT sum(cnt) AS n, CAST(ceil(0.2 * sum(cnt)) AS BIGINT) AS n_test FROM c),
e AS (SELECT lang, cnt, (n - n_test) * cnt / n AS ex, floor((n - n_test) * cnt / n) AS fl, n - n_test AS n_train FROM c, t),
r AS (SELECT *, row_number() OVER (ORDER BY ex - fl DESC, lang) AS rr,
             n_train - sum(fl) OVER () AS leftover FROM e),
q AS (SELECT lang, CAST(fl + CASE WHEN rr <= leftover THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r),
rk AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(concat_ws(':', '42', doc_id)), doc_id) AS rn
       FROM documents),
sp AS (SELECT rk.doc_id AS row_id, rk.lang AS label, CASE WHEN rn <= quota THEN 'train' ELSE 'val' END AS split
       FROM rk JOIN q USING (lang))"""


def _split(spark, sf) -> DataFrame:
    s = tables.single_label_sentences(_t(spark, sf, "documents"))
    return split.stratified_split(s, "label", "row_id", test_size=0.2, seed=42)


@query("o_m1_stratified_split", f"WITH {SPLIT_SQL} SELECT row_id, label, split FROM sp")
def stratified_split(spark, sf):
    return _split(spark, sf).select("row_id", "label", "split")


@query("o_w8_split_quotas", f"WITH {SPLIT_SQL} SELECT label, split, count(*) AS n FROM sp GROUP BY label, split")
def split_quotas(spark, sf):
    return _split(spark, sf).groupBy("label", "split").agg(F.count(F.lit(1)).cast("long").alias("n"))


@query("o_m2_label_encode", f"""
WITH {SPLIT_SQL},
codes AS (SELECT label, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_code
          FROM (SELECT DISTINCT label FROM sp WHERE split = 'train'))
SELECT row_id, label, split, label_code FROM sp JOIN codes USING (label)
""")
def label_encode(spark, sf):
    sp = _split(spark, sf)
    idx = model.label_index(sp.where(F.col("split") == "train"))
    return model.encode_labels(idx, sp).select("row_id", "label", "split", "label_code")


ENCODE_SQL = f"""
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY token) + 999 AS INTEGER) AS id
          FROM (SELECT DISTINCT unnest({S.word_list('lower(text)')}) AS token FROM benchmark)),
dw AS (SELECT doc_id, {S.word_list('lower(text)')} AS wl FROM documents),
wp AS (SELECT doc_id, unnest(wl) AS token, unnest(generate_series(1, len(wl))) AS wpos FROM dw),
wid AS (SELECT doc_id, wpos, coalesce(v.id, 100) AS id FROM wp LEFT JOIN vocab v USING (token)),
grid AS (SELECT doc_id, CAST(len(wl) AS BIGINT) AS n_tokens, least(len(wl), 126) AS m,
                unnest(generate_series(0, 127)) AS pos FROM dw)"""


@query("o_m3_encode", f"""
WITH {ENCODE_SQL}
SELECT g.doc_id AS row_id, CAST(g.pos AS INTEGER) AS pos, g.n_tokens,
       CAST(CASE WHEN g.pos = 0 THEN 101 WHEN g.pos <= g.m THEN w.id WHEN g.pos = g.m + 1 THEN 102 ELSE 0 END AS INTEGER)
         AS input_id,
       CAST(CASE WHEN g.pos <= g.m + 1 THEN 1 ELSE 0 END AS INTEGER) AS attention_mask
FROM grid g LEFT JOIN wid w ON w.doc_id = g.doc_id AND w.wpos = g.pos
""")
def encode(spark, sf):
    vocab = model.vocab_from_texts(_t(spark, sf, "benchmark"), "text")
    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")
    enc = model.encode_texts(docs, "text", vocab, max_length=128)
    return enc.select("row_id", "n_tokens", F.posexplode(F.arrays_zip("input_ids", "attention_mask")).alias("pos", "z")) \
        .select("row_id", F.col("pos").cast("int").alias("pos"), "n_tokens", F.col("z.input_ids").alias("input_id"),
                F.col("z.attention_mask").alias("attention_mask"))


@query("o_m3_wordpiece", f"""
WITH RECURSIVE {S.TOKENS},
v AS (SELECT DISTINCT token AS piece FROM tokens WHERE token NOT IN ('[CLS]', '[SEP]')),
m AS (SELECT max(length(regexp_replace(piece, '^##', ''))) AS most FROM v),
w AS (SELECT DISTINCT unnest({S.word_list('lower(text)')}) AS word FROM documents),
s1 AS (SELECT word, unnest(generate_series(0, length(word) - 1)) AS s FROM w WHERE length(word) <= 100),
s2 AS (SELECT word, s, unnest(generate_series(1, least(length(word) - s, most))) AS l FROM s1, m),
h AS (SELECT word, s, max(l) AS l FROM s2 JOIN v ON piece = (CASE WHEN s > 0 THEN '##' ELSE '' END) || substring(word, CAST(s + 1 AS INT), CAST(l AS INT))
      GROUP BY word, s),
walk AS (SELECT word, CAST(0 AS BIGINT) AS pos, '' AS pieces FROM w UNION ALL
         SELECT walk.word, pos + h.l, pieces || (CASE WHEN pos = 0 THEN '' ELSE ' ##' END) || substring(walk.word, CAST(pos + 1 AS INT), CAST(h.l AS INT))
         FROM walk JOIN h ON h.word = walk.word AND h.s = walk.pos)
SELECT word AS token, coalesce(max(pieces) FILTER (WHERE pos = length(word)), '[UNK]') AS pieces FROM walk GROUP BY word
""")
def wordpiece(spark, sf):
    """Greedy longest-match pieces of every distinct word of ``documents``; the vocabulary is the pieces of ``benchmark``."""
    vocab = tokens(spark, sf).where(~F.col("token").isin("[CLS]", "[SEP]")).select("token").distinct()
    ws = _t(spark, sf, "documents").select(F.explode(text_words(F.lower("text"))).alias("token"))
    return model.word_pieces(ws, vocab).select("token", F.array_join("pieces", " ").alias("pieces"))


@query("o_m4_train_classifier")
def train_classifier(spark, sf):
    """Distributed multinomial text classifier fit on the train part, scored on
    the validation part (iterative fit: row-count check only)."""
    sp = reliable_checkpoint(_split(spark, sf))
    m = model.fit_classifier(sp.where(F.col("split") == "train"), text="sentence", label="label", max_iter=30)
    val = sp.where(F.col("split") == "val").withColumnRenamed("label", "y_true")
    p = model.predict(m, val, "row_id", "sentence", keep=["y_true"])
    return p.select("row_id", "y_true", F.col("label").alias("y_pred"))


@query("o_m5_candidate_models")
def candidate_models(spark, sf):
    """Three iteration budgets (epochs) fit and evaluated; one metrics row each."""
    sp = reliable_checkpoint(_split(spark, sf))
    return rnd(model.evaluate_candidates(sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val"),
                                         iters=(2, 5, 20)))


@query("o_m6_best_model", f"""
WITH {SPLIT_SQL} SELECT row_id, label AS y_true, CAST(1 AS DOUBLE) AS prob_sum, TRUE AS known_label FROM sp WHERE split = 'val'
""")
def best_model(spark, sf):
    """Train, keep the best candidate, save, reload, predict the validation part: what must hold of any
    fitted model (who is scored, probabilities sum to 1, the label is a class); accuracy is in pytest."""
    sp = reliable_checkpoint(_split(spark, sf))
    path = scratch_path(spark, "best-model")
    train, val = sp.where(F.col("split") == "train"), sp.where(F.col("split") == "val")
    model.train_and_select(train, val, iters=(2, 10), path=path)
    p = model.predict(model.load_model(path), val.withColumnRenamed("label", "y_true"), "row_id", "sentence", keep=["y_true"])
    probs = [c for c in p.columns if c.startswith("prob_LABEL_")]
    return rnd(p.select("row_id", "y_true", sum(F.col(c) for c in probs).alias("prob_sum"),
                        F.col("label").isin([c for c, _ in tables.SCORE_LETTERS]).alias("known_label")))


# --- one training run in epochs: settings, and the same run in SQL (a step is a CTE)
EPOCHS, EPOCH_BATCHES, EPOCH_LR, EPOCH_FEATURES = 3, 4, 0.05, 1 << 14


def _epoch_run_sql(final: str) -> str:
    """The AdamW run over ``documents``: parameters (feature, class) after every step; the bias is feature -1."""
    steps = EPOCHS * EPOCH_BATCHES
    ctes = [SPLIT_SQL.strip(), f"""
words AS (SELECT doc_id AS row_id, unnest({S.word_list('lower(text)')}) AS w FROM documents),
tf AS (SELECT row_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % {EPOCH_FEATURES} AS INTEGER) AS i, count(*) AS tf
       FROM words GROUP BY row_id, i),
unit AS MATERIALIZED (
  SELECT row_id, i, ln(1 + tf) / sqrt(sum(ln(1 + tf) * ln(1 + tf)) OVER (PARTITION BY row_id)) AS x FROM tf
  UNION ALL SELECT row_id, -1, 1.0 FROM sp),
ranked AS (SELECT row_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', row_id)), row_id) AS rn, count(*) OVER () AS n
           FROM sp WHERE split = 'train'),
rows AS MATERIALIZED (SELECT sp.row_id, label, split, CAST(floor((rn - 1) * {EPOCH_BATCHES} / n) AS INTEGER) AS batch
                      FROM sp LEFT JOIN ranked USING (row_id)),
classes AS (SELECT DISTINCT label AS c FROM sp WHERE split = 'train'),
param0 AS MATERIALIZED (SELECT i, c, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
                        FROM (SELECT DISTINCT i FROM unit), classes)"""]

    def probabilities(name: str, params: str, where: str) -> str:
        return f"""
{name}_z AS (SELECT row_id, label, c, sum(x * w) AS z FROM rows JOIN unit USING (row_id) JOIN {params} USING (i)
             WHERE {where} GROUP BY row_id, label, c),
{name}_e AS (SELECT *, exp(z - max(z) OVER (PARTITION BY row_id)) AS e FROM {name}_z),
{name} AS MATERIALIZED (SELECT row_id, label, c, e / sum(e) OVER (PARTITION BY row_id) AS p FROM {name}_e)"""

    for s in range(steps):
        epoch = s // EPOCH_BATCHES + 1
        b = training.batch_order(EPOCH_BATCHES, epoch, 42)[s % EPOCH_BATCHES]
        ctes.append(probabilities(f"p{s}", f"param{s}", f"split = 'train' AND batch = {b}"))
        ctes.append(f"""
g{s} AS MATERIALIZED (
  SELECT i, c, sum(x * (p - CASE WHEN c = label THEN 1 ELSE 0 END)) / (SELECT count(DISTINCT row_id) FROM p{s}) AS g
  FROM p{s} JOIN unit USING (row_id) GROUP BY i, c),
clip{s} AS (SELECT least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS k FROM g{s}),
mom{s} AS (SELECT i, c, w, m + (1 - 0.9) * (coalesce(g, 0) * k - m) AS m,
                  v + (1 - 0.999) * (coalesce(g, 0) * k * coalesce(g, 0) * k - v) AS v
           FROM param{s} LEFT JOIN g{s} USING (i, c), clip{s}),
param{s + 1} AS MATERIALIZED (
  SELECT i, c, w - {EPOCH_LR * (1 - s / steps)!r} * (m / (1 - pow(0.9, {s + 1}))) / (sqrt(v / (1 - pow(0.999, {s + 1}))) + 1e-8) AS w,
         m, v FROM mom{s})""")
    evals = []
    for epoch in range(1, EPOCHS + 1):
        ctes.append(probabilities(f"v{epoch}", f"param{epoch * EPOCH_BATCHES}", "split = 'val'"))
        evals.append(f"""SELECT {epoch} AS epoch, row_id, label AS y_true, arg_max(c, p) AS y_pred, max(p) AS prob,
                         -ln(max(p) FILTER (WHERE c = label)) AS nll FROM v{epoch} GROUP BY row_id, label""")
    losses = " UNION ALL ".join(f"SELECT {s // EPOCH_BATCHES + 1} AS epoch, -ln(p) AS nll FROM p{s} WHERE c = label"
                                for s in range(steps))
    ctes.append(f"""
val AS MATERIALIZED ({" UNION ALL ".join(evals)}),
conf AS (SELECT epoch, y_true, y_pred, count(*) AS n FROM val GROUP BY ALL),
per AS (SELECT epoch, c, coalesce(sum(n) FILTER (WHERE y_true = c AND y_pred = c), 0) AS tp,
               coalesce(sum(n) FILTER (WHERE y_true = c), 0) AS support, coalesce(sum(n) FILTER (WHERE y_pred = c), 0) AS predicted
        FROM conf, classes GROUP BY epoch, c),
f1 AS (SELECT epoch, sum(support * CASE WHEN support + predicted = 0 THEN 0 ELSE 2.0 * tp / (support + predicted) END)
                     / sum(support) AS f1 FROM per GROUP BY epoch),
best AS (SELECT epoch FROM f1 ORDER BY round(f1, 12) DESC, epoch LIMIT 1),
loss AS (SELECT epoch, avg(nll) AS train_loss FROM ({losses}) GROUP BY epoch),
ev AS (SELECT epoch, avg(nll) AS eval_loss FROM val GROUP BY epoch)""")
    return "WITH " + ",".join(ctes) + " " + final


def _epoch_run(spark, sf):
    sp = reliable_checkpoint(_split(spark, sf))
    val = sp.where(F.col("split") == "val")
    return training.train_epochs(sp.where(F.col("split") == "train"), val, epochs=EPOCHS, batches=EPOCH_BATCHES, lr=EPOCH_LR,
                                 features=EPOCH_FEATURES), val


@query("o_m4_train_epochs", _epoch_run_sql("""
SELECT epoch, round(train_loss, 6) AS train_loss, round(eval_loss, 6) AS eval_loss, round(f1, 6) AS eval_f1,
       epoch = (SELECT epoch FROM best) AS is_best FROM loss JOIN ev USING (epoch) JOIN f1 USING (epoch)"""))
def train_epochs(spark, sf):
    """One AdamW run in mini-batches: the train and eval records of its log beside each other, by epoch."""
    run, _ = _epoch_run(spark, sf)
    evals = run.log.where(F.col("eval_loss").isNotNull()).select(F.col("epoch").cast("int"), "eval_f1")
    curves = trainlog.training_curves(run.log).select(F.col("epoch").cast("int"), "train_loss", "eval_loss")
    return rnd(curves.join(evals, "epoch").withColumn("is_best", F.col("epoch") == run.best_epoch))


@query("o_m5_epoch_confusion", _epoch_run_sql("SELECT epoch, y_true, y_pred, n FROM conf"))
def epoch_confusion(spark, sf):
    """The confusion counts of the validation part after every epoch of the run."""
    return _epoch_run(spark, sf)[0].confusion.drop("nll")


@query("o_m6_best_epoch_model", _epoch_run_sql("""
SELECT row_id, y_true, y_pred, round(prob, 6) AS prob FROM val WHERE epoch = (SELECT epoch FROM best)"""))
def best_epoch_model(spark, sf):
    """The best epoch's weights, read back from the run's folder, score the validation part."""
    run, val = _epoch_run(spark, sf)
    best = training.load_epoch(spark, run.path, run.best_epoch)
    p = training.predict_classes(best, val.withColumnRenamed("label", "y_true"), keep=("row_id", "y_true"))
    return rnd(p.select("row_id", "y_true", F.col("label").alias("y_pred"), F.array_max("probabilities").alias("prob")))


def _score_sql() -> str:
    m = "greatest(s_de, s_en, s_es, s_fr)"
    z = f"(exp(s_de - {m}) + exp(s_en - {m}) + exp(s_es - {m}) + exp(s_fr - {m}))"
    return f"""
WITH {S.letter_scores()}
SELECT row_id, sentence, {S.ARGMAX} AS label,
       round(exp(s_de - {m}) / {z}, 6) AS prob_LABEL_0, round(exp(s_en - {m}) / {z}, 6) AS prob_LABEL_1,
       round(exp(s_es - {m}) / {z}, 6) AS prob_LABEL_2, round(exp(s_fr - {m}) / {z}, 6) AS prob_LABEL_3
FROM lg"""


@query("o_m8_batch_score", _score_sql())
def batch_score(spark, sf):
    """Fixed scorer: class-letter logits -> softmax -> argmax -> code -> name."""
    lg = tables.letter_logits(_t(spark, sf, "documents"))
    mapping = {f"LABEL_{i}": c for i, (c, _) in enumerate(tables.SCORE_LETTERS)}
    return rnd(model.score_logits(lg, "logits", mapping, keep=("row_id", "sentence")))


@query("o_m8_user_model", _score_sql())
def user_model(spark, sf):
    """A user's model, loaded once per worker and fed padded batches; here it counts the class letters."""
    letters = np.array([ord(ch) for _, ch in tables.SCORE_LETTERS])

    def load():
        def tokenize(sentence):
            return np.frombuffer(sentence.encode("utf-32-le"), "<u4").tolist()

        def forward(ids, mask):
            return np.stack([((ids == c) & (mask == 1)).sum(axis=1) for c in letters], axis=1)
        return tokenize, forward

    docs = _t(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("sentence"))
    lg = scoring.with_logits(docs, load, batch_size=16, max_length=None)
    mapping = {f"LABEL_{i}": c for i, (c, _) in enumerate(tables.SCORE_LETTERS)}
    return rnd(model.score_logits(lg, "logits", mapping, keep=("row_id", "sentence")))


@query("o_m9_map_batches", "SELECT doc_id AS row_id, CAST(length(nfc_normalize(text)) AS BIGINT) AS n_chars_nfc FROM documents")
def map_batches(spark, sf):
    """A pandas function applied to Arrow batches: code points after Unicode NFC, which Spark has no function for."""
    def fn(pdf):
        import unicodedata

        import pandas as pd
        n = [None if t is None else len(unicodedata.normalize("NFC", t)) for t in pdf["text"]]
        return pd.DataFrame({"row_id": pdf["doc_id"], "n_chars_nfc": pd.array(n, dtype="Int64")})
    return model.map_batches(_t(spark, sf, "documents").select("doc_id", "text"), fn, "row_id long, n_chars_nfc long")
