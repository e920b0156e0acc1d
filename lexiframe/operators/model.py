"""Text classification on Spark ML: label encoding, fixed-length encoding with a
vocabulary table, a distributed multinomial classifier, batch scoring, and a
batch-map hook for user models.

The transformer fine-tuning of the original workflow is re-aimed at a Spark ML
pipeline (tokenizer -> term frequencies -> IDF -> multinomial logistic
regression): a distributed fit whose coefficients travel to executors with the
model.  Metrics, best-candidate choice and reports reuse ``metrics``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import DEFAULT_MAX_LENGTH, LABEL_MAPPING, SUBWORD_PREFIX, WS_RUN
from ..functions.text import words
from ..functions.vectors import argmax, decode_label, softmax, vector_columns
from ..session import reliable_checkpoint
from .metrics import evaluate_counts
from .ranking import join_small

PAD_ID, UNK_ID, CLS_ID, SEP_ID = 0, 100, 101, 102
UNK_TOKEN = "[UNK]"


# ----------------------------------------------------------------------------- labels

def label_index(train: DataFrame, label: str = "label", out: str = "label_code") -> DataFrame:
    """label, code: the sorted class names of ``train`` numbered 0..n-1, as a frame."""
    from .ranking import sequence_number
    ranked = sequence_number(train.select(label).distinct(), [], [label], out="__rn")
    return ranked.select(label, (F.col("__rn") - 1).cast("int").alias(out))


def encode_labels(index: DataFrame, df: DataFrame, label: str = "label", out: str = "label_code") -> DataFrame:
    """Adds the code of each row's label; a label that the index lacks raises."""
    coded = join_small(df, index, [label], "left")
    unseen = F.raise_error(F.concat(F.lit("unseen label: "), F.coalesce(F.col(label), F.lit("null")))).cast("int")
    return coded.withColumn(out, F.coalesce(F.col(out), unseen))


# ----------------------------------------------------------------------------- encoding

def vocab_from_texts(texts: DataFrame, text: str = "text", first_id: int = 1000) -> DataFrame:
    """A whitespace vocabulary (token, id): distinct lower-case words, ids in
    sorted order from ``first_id`` (a range-partitioned global ordinal)."""
    from .ranking import sequence_number
    w = texts.select(F.explode(words(F.lower(F.col(text)))).alias("token")).distinct()
    ranked = sequence_number(w, [], ["token"], out="__rn")
    return ranked.select("token", (F.col("__rn") + first_id - 1).cast("int").alias("id"))


def word_pieces(words_: DataFrame, vocab: DataFrame, word: str = "token", max_chars: int = 100) -> DataFrame:
    """Greedy longest-match word pieces of every distinct word: ``word``, pieces (array).

    A piece inside a word carries the ``##`` prefix in the vocabulary (column ``token``).  A
    word that cannot be covered, or of more than ``max_chars`` characters, is ``[UNK]``.
    Plan: every substring of a distinct word, no longer than the longest piece, is looked up
    by one join; the longest hit per start comes back as a map of at most ``max_chars``
    entries and one pass over it walks the word."""
    longest = vocab.agg(F.coalesce(F.max(F.length(F.regexp_replace("token", f"^{SUBWORD_PREFIX}", ""))), F.lit(1)))
    base = words_.select(F.col(word).alias("__w")).distinct().where(F.length("__w") > 0)
    short = base.where(F.length("__w") <= max_chars)
    n = F.length("__w")
    sub = short.select("__w", F.explode(F.sequence(F.lit(0), n - 1)).alias("__s")) \
        .select("__w", "__s", F.explode(F.sequence(F.lit(1), F.least(n - F.col("__s"), longest.scalar()))).alias("__l"))
    piece = F.concat(F.when(F.col("__s") > 0, F.lit(SUBWORD_PREFIX)).otherwise(F.lit("")),
                     F.substring(F.col("__w"), F.col("__s") + 1, F.col("__l")))
    known = vocab.select(F.col("token").alias("__piece")).distinct()
    hits = sub.withColumn("__piece", piece).join(known, "__piece").groupBy("__w", "__s").agg(F.max("__l").alias("__l"))
    maps = hits.groupBy("__w").agg(F.map_from_entries(F.collect_list(F.struct("__s", "__l"))).alias("__m"))

    def step(acc, i):
        size = F.try_element_at(F.col("__m"), i)
        part = F.concat(F.when(i > 0, F.lit(SUBWORD_PREFIX)).otherwise(F.lit("")), F.substring(F.col("__w"), i + 1, size))
        here = F.struct((i + size).alias("pos"), F.concat(acc["out"], F.array(part)).alias("out"))
        return F.when((acc["pos"] == i) & size.isNotNull(), here).otherwise(acc)

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    walked = F.aggregate(F.sequence(F.lit(0), n - 1), start, step)
    found = maps.select("__w", walked.alias("a")).where(F.col("a.pos") == n).select("__w", F.col("a.out").alias("pieces"))
    out = base.join(found, "__w", "left")
    return out.select(F.col("__w").alias(word), F.coalesce("pieces", F.array(F.lit(UNK_TOKEN))).alias("pieces"))


def encode_texts(df: DataFrame, text: str, vocab: DataFrame, max_length: int = DEFAULT_MAX_LENGTH,
                 padding: str = "max_length", lowercase: bool = True, id_col: str = "row_id",
                 pieces: DataFrame | None = None) -> DataFrame:
    """``input_ids`` / ``attention_mask`` of fixed length: ``[CLS]`` + ids + ``[SEP]``,
    truncated so the specials fit inside ``max_length`` (the tokenizer's truncation), padded
    with 0 to ``max_length`` (or to the longest row when ``padding='longest'``).  Words map
    to vocabulary ids as they are, or as the ``pieces`` of :func:`word_pieces`.  The whole
    text is split; ``n_tokens`` counts all of its words.

    Plan: words beyond ``max_length`` are cut off before the explode (a word is at least one
    piece) -> equi-joins on the word and the piece (AQE makes them broadcast hash joins when
    the table is measured small, skew-split sort-merge joins otherwise) -> regroup per text
    (a group is one text's kept tokens).
    """
    t = F.lower(F.col(text)) if lowercase else F.col(text)
    room = max(max_length - 2, 0)
    base = df.select(id_col, words(t).alias("__w"))
    ex = base.select(id_col, F.size("__w").cast("long").alias("n_tokens"),
                     F.posexplode_outer(F.slice("__w", 1, room) if room else F.array().cast("array<string>")).alias("__pos", "token"))
    order = ["__pos"]
    if pieces is not None:
        cut = ex.join(pieces.select("token", "pieces"), "token", "left").withColumn(
            "pieces", F.when(F.col("__pos").isNull(), F.lit(None)).otherwise(F.coalesce("pieces", F.array(F.lit(UNK_TOKEN)))))
        ex = cut.select(id_col, "n_tokens", "__pos", F.posexplode_outer("pieces").alias("__part", "token"))
        order = ["__pos", "__part"]
    mapped = ex.join(vocab.select("token", F.col("id").cast("int").alias("id")), "token", "left")
    kept = F.when(F.col("__pos").isNotNull(), F.struct(*order, F.coalesce("id", F.lit(UNK_ID)).alias("id")))
    enc = mapped.groupBy(id_col).agg(F.first("n_tokens").alias("n_tokens"),
                                     F.array_sort(F.collect_list(kept)).alias("__s"))
    body = F.slice(F.transform("__s", lambda x: x["id"]), 1, room) if room else F.array().cast("array<int>")
    core = F.concat(F.array(F.lit(CLS_ID)), body, F.array(F.lit(SEP_ID)))
    enc = enc.select(id_col, "n_tokens", core.alias("__core"))
    if padding == "max_length":
        width = F.lit(max_length)
    elif padding == "longest":
        width = enc.agg(F.max(F.size("__core"))).scalar()
    else:
        raise ValueError("padding must be 'max_length' or 'longest'")
    pad = F.greatest(width - F.size("__core"), F.lit(0))
    return enc.select(id_col, "n_tokens",
                      F.concat("__core", F.array_repeat(F.lit(PAD_ID), pad)).alias("input_ids"),
                      F.concat(F.array_repeat(F.lit(1), F.size("__core")), F.array_repeat(F.lit(0), pad))
                      .alias("attention_mask"))


def map_batches(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """Apply a pandas function to Arrow batches of every partition (``map(batched=True)``)."""
    def run(batches):
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


# ----------------------------------------------------------------------------- training

def text_features(text: str = "sentence", label: str = "label", num_features: int = 1 << 16) -> list:
    """Stages: label index (alphabetical), tokenizer (Python whitespace), hashed term frequencies, IDF."""
    return [StringIndexer(inputCol=label, outputCol="label_idx", stringOrderType="alphabetAsc", handleInvalid="error"),
            RegexTokenizer(inputCol=text, outputCol="__tokens", pattern=WS_RUN, gaps=True, toLowercase=True),
            HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features),
            IDF(inputCol="__tf", outputCol="features")]


def _regression(max_iter: int, reg: float) -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label_idx", family="multinomial", maxIter=max_iter,
                              regParam=reg)


def text_classifier(text: str = "sentence", label: str = "label", max_iter: int = 50, reg: float = 0.0,
                    num_features: int = 1 << 16) -> Pipeline:
    """:func:`text_features` and multinomial logistic regression (deterministic: no seed)."""
    return Pipeline(stages=[*text_features(text, label, num_features), _regression(max_iter, reg)])


def fit_classifier(train: DataFrame, text: str = "sentence", label: str = "label", max_iter: int = 50, reg: float = 0.0,
                   num_features: int = 1 << 16) -> PipelineModel:
    """The fitted :func:`text_classifier`; the features are stored once and not made again for the regression."""
    stages = Pipeline(stages=text_features(text, label, num_features)).fit(train)
    stored = reliable_checkpoint(stages.transform(train).select("label_idx", "features"))
    return PipelineModel(stages=[*stages.stages, _regression(max_iter, reg).fit(stored)])


def class_names(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, df: DataFrame, id_col: str = "row_id", text: str = "sentence",
            keep: Sequence[str] = ()) -> DataFrame:
    """Batch scoring: predicted class name and one probability column per class
    (``prob_LABEL_i``).  Stateless — works on a streaming DataFrame as well."""
    if "label" in keep:
        raise ValueError("'label' is the predicted column; rename the true label before scoring")
    names = class_names(model)
    scored = model.transform(df)
    prob = vector_to_array("probability")
    label = F.element_at(F.array(*[F.lit(n) for n in names]), argmax(prob) + 1)
    return scored.select(id_col, *keep, text, label.alias("label"),
                         *vector_columns(prob, [f"LABEL_{i}" for i in range(len(names))]))


def train_and_select(train: DataFrame, val: DataFrame, iters: Sequence[int] = (5, 10, 20), text: str = "sentence",
                     label: str = "label", num_features: int = 1 << 16, reg: float = 0.0,
                     path: str | None = None, run: str = "run") -> tuple[PipelineModel, DataFrame]:
    """Train, evaluate per epoch, keep the best: (best model, log records).

    Features are fitted once and stored for all candidates (iteration budgets, one per
    epoch).  Each epoch logs a train record (loss) and an eval record (eval_loss = mean
    negative log probability of the true class, accuracy, weighted scores, mcc, kappa), in
    the shape that ``flatten_log`` and ``training_curves`` read.  The best model has the
    greatest weighted F1, the earliest on ties; ``path`` saves it."""
    stages = Pipeline(stages=text_features(text, label, num_features)).fit(train)
    tr, va = (reliable_checkpoint(stages.transform(part).select("label_idx", "features")) for part in (train, val))
    best, records = None, []
    for epoch, budget in enumerate(iters, start=1):
        fitted = _regression(budget, reg).fit(tr)
        probability = vector_to_array("probability")
        scored = fitted.transform(va).select(
            F.col("label_idx").alias("y_true"), F.col("prediction").alias("y_pred"),
            F.get(probability, F.col("label_idx").cast("int")).alias("p"))
        counts = scored.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"), F.sum(
            -F.log(F.greatest("p", F.lit(1e-15)))).alias("nll"))
        counts = reliable_checkpoint(counts)
        total = counts.agg(F.sum("n").alias("n"), F.sum("nll").alias("nll")).first()
        scores = evaluate_counts(counts.select("y_true", "y_pred", "n")).first()
        step = int(fitted.summary.totalIterations)
        loss = float(fitted.summary.objectiveHistory[-1])
        records.append((run, epoch, 2 * epoch - 1, float(epoch), budget, step, loss, *[None] * 7))
        records.append((run, epoch, 2 * epoch, float(epoch), budget, step, None, total["nll"] / total["n"], scores["accuracy"],
                        scores["precision"], scores["recall"], scores["f1"], scores["mcc"], scores["kappa"]))
        if best is None or scores["f1"] > best[0]:
            best = scores["f1"], fitted
    model = PipelineModel(stages=[*stages.stages, best[1]])
    if path is not None:
        save_model(model, path)
    schema = ("run string, step long, log_pos long, epoch double, max_iter long, iterations long, loss double, "
              "eval_loss double, eval_accuracy double, eval_precision double, eval_recall double, eval_f1 double, "
              "eval_mcc double, eval_kappa double")
    return model, train.sparkSession.createDataFrame(records, schema)


def evaluate_candidates(train: DataFrame, val: DataFrame, iters: Sequence[int] = (5, 10, 20), **kw) -> DataFrame:
    """The eval records of :func:`train_and_select`: epoch, max_iter, accuracy, precision, recall, f1, mcc, kappa."""
    log = train_and_select(train, val, iters, **kw)[1].where(F.col("eval_loss").isNotNull())
    return log.select(F.col("step").cast("int").alias("epoch"), F.col("max_iter").cast("int").alias("max_iter"),
                      *[F.col(f"eval_{m}").alias(m) for m in ("accuracy", "precision", "recall", "f1", "mcc", "kappa")])


# ----------------------------------------------------------------------------- fixed scorer

def score_logits(df: DataFrame, logits: str = "logits", mapping: Mapping[str, str] = LABEL_MAPPING,
                 keep: Sequence[str] = ("row_id", "sentence")) -> DataFrame:
    """logits -> softmax -> argmax (first on ties) -> ``LABEL_i`` -> mapped name,
    plus ``prob_LABEL_i`` columns (named by code, not by mapped name)."""
    p = df.select(*keep, softmax(logits).alias("__p"))
    n = len(mapping)
    return p.select(*keep, decode_label(argmax("__p"), mapping).alias("label"),
                    *vector_columns("__p", [f"LABEL_{i}" for i in range(n)]))


def linear_logits(features: str, weights: Sequence[Sequence[float]], bias: Sequence[float]):
    """``W @ x + b`` for an array<float> feature column, as higher-order functions."""
    x = F.col(features).cast("array<double>")
    rows = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in wr]), lambda a, b: a * b),
                        F.lit(float(b0)), lambda acc, v: acc + v) for wr, b0 in zip(weights, bias)]
    return F.array(*rows)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
