"""DuckDB text of the oracle side: shared fragments (CTEs) for the inputs that
Spark derives from the driver tables.  Kept next to the catalog so that every
query and its oracle are read together.
"""

from ..functions.fixed import ENGLISH_STOP_WORDS, LINE_BREAKS_RE2, WS_CLASS_RE2

WS = WS_CLASS_RE2 + "+"


def word_list(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{WS}'), lambda x: x <> '')"


def word_count(t: str) -> str:
    return f"CAST(len({word_list(t)}) AS BIGINT)"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{WS}|{WS}$', '', 'g')"


def sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


STOP_WORDS = sql_list(ENGLISH_STOP_WORDS)
LINES = LINE_BREAKS_RE2

SENTENCES = ("sent AS (SELECT doc_id AS row_id, text AS sentence, concat_ws(',', lang, source) AS label, "
             f"{word_count('text')} AS n_words FROM documents)")

EXPLODED = ("ex AS (SELECT row_id, sentence, label, n_words, CAST(label_pos AS INTEGER) AS label_pos, label_item FROM ("
            "SELECT row_id, sentence, label, n_words, unnest(generate_series(0, len(string_split(label, ',')) - 1)) "
            "AS label_pos, unnest(string_split(label, ',')) AS label_item FROM sent))")

ROLES = ("roles AS (SELECT conv_id AS row_id, string_agg(role, ',' ORDER BY turn) AS label "
         "FROM conversations GROUP BY conv_id)")

TOKENS = (
    "tok0 AS (SELECT item_id AS sample_id, list_concat(['[CLS]'], flatten(list_transform("
    f"{word_list('lower(text)')}, lambda w: CASE WHEN length(w) > 5 THEN [substring(w, 1, 5), '##' || substring(w, 6)] "
    "ELSE [w] END)), ['[SEP]']) AS toks FROM benchmark), "
    "tokens AS (SELECT sample_id, CAST(unnest(generate_series(0, len(toks) - 1)) AS INTEGER) AS pos, "
    "unnest(toks) AS token FROM tok0)")


def attention(name: str = "att", run: str = "eval") -> str:
    a, b, c, d, off, m = (7, 13, 3, 5, 0, 11) if run == "eval" else (5, 11, 2, 3, 1, 13)
    raw = f"(({a}*q.pos + {b}*k.pos + {c}*layer + {d}*head + {off} + ascii(q.token) + ascii(k.token)) % {m} + 1)"
    return (
        f"{name} AS (SELECT q.sample_id, CAST(layer AS INTEGER) AS layer, CAST(head AS INTEGER) AS head, "
        f"CAST(q.pos AS INTEGER) AS q, CAST(k.pos AS INTEGER) AS k, CAST({raw} AS DOUBLE) / "
        f"sum({raw}) OVER (PARTITION BY q.sample_id, layer, head, q.pos) AS weight "
        f"FROM tokens q JOIN tokens k ON k.sample_id = q.sample_id, (SELECT unnest([0, 1, 2]) AS layer), "
        f"(SELECT unnest([0, 1]) AS head))")


LOG = (
    "ev AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS log_pos, value, "
    "CAST(json_extract_string(props, '$.k') AS DOUBLE) AS kk FROM events), "
    "log AS (SELECT run, CAST(log_pos AS BIGINT) AS log_pos, CAST(floor((log_pos + 1) / 2) AS BIGINT) AS step, "
    "CAST(floor((log_pos + 1) / 2) AS DOUBLE) AS epoch, "
    "CASE WHEN (log_pos + run) % 2 = 1 THEN value / 100 END AS loss, "
    "CASE WHEN (log_pos + run) % 2 = 0 THEN value / 100 END AS eval_loss, "
    "CASE WHEN (log_pos + run) % 2 = 0 THEN kk / 100 END AS eval_f1, "
    "CASE WHEN (log_pos + run) % 2 = 0 THEN (100 - kk) / 100 END AS eval_accuracy FROM ev)")


def letter_scores(bias_en: int = 0, name: str = "lg") -> str:
    def cnt(ch):
        return f"CAST(length(text) - length(replace(text, '{ch}', '')) AS DOUBLE)"
    return (f"{name} AS (SELECT doc_id AS row_id, text AS sentence, lang AS y_true, {cnt('ü')} AS s_de, "
            f"{cnt('w')} + {bias_en} AS s_en, {cnt('ó')} AS s_es, {cnt('é')} AS s_fr FROM documents)")


ARGMAX = ("CASE WHEN s_de >= s_en AND s_de >= s_es AND s_de >= s_fr THEN 'de' "
          "WHEN s_en >= s_es AND s_en >= s_fr THEN 'en' WHEN s_es >= s_fr THEN 'es' ELSE 'fr' END")

PRED = "pred AS (SELECT row_id, y_true, " + ARGMAX + " AS y_pred FROM lg)"


def merge_words(src: str, name: str) -> str:
    """Sub-token merge of a (sample_id, pos, token, score) relation."""
    return (
        f"{name}_w AS (SELECT *, CAST(sum(CASE WHEN starts_with(token, '##') THEN 0 ELSE 1 END) OVER "
        f"(PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) "
        f"AS word_id FROM {src}), "
        f"{name} AS (SELECT * FROM (SELECT sample_id, word_id, string_agg(CASE WHEN starts_with(token, '##') "
        f"THEN substring(token, 3) ELSE token END, '' ORDER BY pos) AS word, sum(score) AS score, "
        f"min(pos) AS first_pos FROM {name}_w GROUP BY sample_id, word_id) WHERE word <> '')")
