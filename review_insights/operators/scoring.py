"""Sentiment scoring (M1..M4).

Three interchangeable scorers produce ``bert_sentiment`` / ``bert_confidence``:

* ``score_lexicon``: pure Catalyst (substring counts of a small positive and
  negative lexicon); deterministic and SQL-checkable.
* ``score_sentiment``: the batch-scoring harness for any Python model.  It runs
  as ``mapInPandas``: each worker builds the model once, receives Arrow batches
  and scores texts of like length together, in batches bounded by their padded
  tokens.  A failing batch is halved until the bad rows are alone; these fall back
  to (neutral, 0.5) and are flagged in ``score_error``.  Raw model labels are
  normalised to positive / negative / neutral in Catalyst afterwards.
* ``train_sentiment_model`` / ``score_with_model``: an MLlib pipeline
  (tokenise, stop words, hashing TF, IDF, logistic regression) trained on the
  rating-derived labels of all rows; confidence is the top class probability.  Fitted
  pipelines are published as versions (``publish_model``) and loaded by phases.
"""

from __future__ import annotations

import sys
import types
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import accumulate

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer, StopWordsRemover, StringIndexer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights import constants as K
from review_insights.functions.labels import normalise_label
from review_insights.functions.text import keyword_hits, lower_or_empty
from review_insights.operators.dims import spread
from review_insights.operators.sampling import exact_sample
from review_insights.session import drop_table, table_path
from review_insights.sources import versions

# FIXED VALUES: the built-in lexicon of the deterministic scorer (our own lists).
POSITIVE_WORDS = ("great", "love", "excellent", "amazing", "wonderful", "best", "delicious", "perfect",
                  "good", "recommend", "favorite", "happy", "tasty", "nice", "fresh")
NEGATIVE_WORDS = ("bad", "terrible", "awful", "poor", "worst", "horrible", "disgusting", "disappointed",
                  "waste", "broken", "bland", "stale", "slow", "overpriced", "bitter")

SENTIMENT_COL, CONFIDENCE_COL, ERROR_COL = "bert_sentiment", "bert_confidence", "score_error"
FALLBACK_LABEL, FALLBACK_SCORE = K.NEUTRAL, 0.5

Scorer = Callable[[Sequence[str]], Sequence[tuple[str, float]]]


# ------------------------------------------------------------------ lexicon --

def score_lexicon(df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Label by more positive than negative hits (or the reverse); ties and no hits
    are neutral.  Confidence = 0.5 + 0.5 * |p - n| / (p + n), 0.5 without hits."""
    out = df.withColumn("_lx_low", lower_or_empty(F.col(text_col)))
    out = out.withColumns({"_lx_p": keyword_hits(F.col("_lx_low"), POSITIVE_WORDS),
                           "_lx_n": keyword_hits(F.col("_lx_low"), NEGATIVE_WORDS)})
    p, n = F.col("_lx_p"), F.col("_lx_n")
    label = F.when(p > n, F.lit(K.POSITIVE)).when(n > p, F.lit(K.NEGATIVE)).otherwise(F.lit(K.NEUTRAL))
    conf = F.when(p + n == 0, F.lit(0.5)).otherwise(F.lit(0.5) + F.lit(0.5) * F.abs(p - n) / (p + n))
    return out.withColumns({SENTIMENT_COL: label, CONFIDENCE_COL: conf}).drop("_lx_low", "_lx_p", "_lx_n")


class PandasLexiconScorer:
    """The lexicon scorer as a batch model: ``texts -> [(raw_label, score)]``.

    A call looks for each word in all its texts at once: joined by line feeds, which no
    word holds.  It costs in proportion to its texts, so the small batches that bounded
    work and halving make cost little more than large ones.  Labels are in the
    upper-case form typical of model pipelines and are normalised by the harness.
    """

    def __call__(self, texts: Sequence[str]) -> list[tuple[str, float]]:
        lows = ["" if text is None or text != text else text.lower() for text in texts]
        joined = "\n".join(lows)
        ends = list(accumulate(len(low) + 1 for low in lows))
        p, n = self._hits(joined, ends, POSITIVE_WORDS), self._hits(joined, ends, NEGATIVE_WORDS)
        return [_LEXICON_RESULTS[counts] for counts in zip(p, n)]

    @staticmethod
    def _hits(joined: str, ends: list[int], words: Sequence[str]) -> list[int]:
        """Number of words in each text."""
        hits = [0] * len(ends)
        for word in words:
            at = joined.find(word)
            while at >= 0:
                place = bisect_right(ends, at)
                hits[place] += 1
                at = joined.find(word, ends[place])
        return hits


def _lexicon_result(p: int, n: int) -> tuple[str, float]:
    label = "POSITIVE" if p > n else "NEGATIVE" if n > p else "NEUTRAL"
    return label, 0.5 + 0.5 * abs(p - n) / (p + n) if p + n else 0.5


_LEXICON_RESULTS = {(p, n): _lexicon_result(p, n) for p in range(len(POSITIVE_WORDS) + 1) for n in range(len(NEGATIVE_WORDS) + 1)}

# ------------------------------------------------------------------ harness --

#: Work of one call of a scorer: rows times the longest of them, in tokens.
BATCH_TOKENS = 16_384
#: Tokens of a text that the scorer reads at most, as the model of the original does.
MAX_TOKENS = 512

def worker_scorers() -> dict[str, Scorer]:
    """Scorers that this Python process has loaded.  The functions of the package travel by value, so what
    outlives a task is kept under a module name of its own."""
    return sys.modules.setdefault("_review_insights_scorers", types.ModuleType("_review_insights_scorers")).__dict__.setdefault("loaded", {})


def word_count(text: str) -> int:
    """Tokens of a text where the scorer brings no tokenizer of its own."""
    return text.count(" ") + 1


def work_batches(lengths: Sequence[int], budget: int) -> Iterator[list[int]]:
    """Places of the texts in batches of like length, the shortest first: as many as keep rows times the
    longest within ``budget``; a text beyond it is a batch of its own."""
    batch: list[int] = []
    for place in sorted(range(len(lengths)), key=lengths.__getitem__):
        if batch and (len(batch) + 1) * lengths[place] > budget:
            yield batch
            batch = []
        batch.append(place)
    if batch:
        yield batch


def score_or_halve(scorer: Scorer, texts: Sequence[str]) -> tuple[list[tuple[str, float]], list[bool]]:
    """Results of the texts, and which ones the scorer cannot score.  A batch that fails is halved until the
    bad texts are alone; all others get their own result."""
    out: list[tuple[str, float]] = [(FALLBACK_LABEL, FALLBACK_SCORE)] * len(texts)
    failed = [False] * len(texts)
    todo = [(0, len(texts))]
    while todo:
        lo, hi = todo.pop()
        if lo == hi:
            continue
        try:
            found = [(label, float(score)) for label, score in scorer(texts[lo:hi])]
            if len(found) != hi - lo:
                raise ValueError("scorer returned a different number of results")
            out[lo:hi] = found
        except Exception:  # noqa: BLE001 - a bad text must not fail the job
            if hi - lo == 1:
                failed[lo] = True
            else:
                middle = (lo + hi) // 2
                todo += [(lo, middle), (middle, hi)]
    return out, failed


def score_sentiment(df: DataFrame, scorer_factory: Callable[[], Scorer] = PandasLexiconScorer,
                    text_col: str = "review_text", batch_tokens: int = BATCH_TOKENS, max_tokens: int = MAX_TOKENS,
                    tokens: Callable[[str], int] = word_count, model_key: str | None = None) -> DataFrame:
    """Score ``text_col`` with a Python batch model, distributed by ``mapInPandas``.

    ``scorer_factory`` loads the model: once a task, or once a Python worker for all
    tasks with the same ``model_key`` (a name and version).  The scorer takes a list of
    texts (null -> '') and returns one ``(label, score)`` per text.  Texts of like
    length go together, in batches of at most ``batch_tokens`` padded tokens, a text
    counting ``tokens(text)`` but no more than ``max_tokens``, where the scorer cuts it;
    whole texts are passed.  Of a batch that fails only the rows that fail alone get the
    fallback and are marked in ``score_error``.
    """
    keep = [f for f in df.schema.fields if f.name not in (SENTIMENT_COL, CONFIDENCE_COL, ERROR_COL)]
    out_schema = T.StructType(keep + [
        T.StructField("_raw_label", T.StringType(), True),
        T.StructField(CONFIDENCE_COL, T.DoubleType(), True),
        T.StructField(ERROR_COL, T.BooleanType(), False),
    ])
    names = [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if model_key is None:
            scorer = scorer_factory()
        else:
            loaded = worker_scorers()
            if model_key not in loaded:
                loaded[model_key] = scorer_factory()
            scorer = loaded[model_key]
        for pdf in batches:
            pdf = pdf[names]
            texts = pdf[text_col].fillna("").astype(str).tolist()
            labels, scores, errors = [FALLBACK_LABEL] * len(texts), [FALLBACK_SCORE] * len(texts), [False] * len(texts)
            for places in work_batches([min(tokens(t), max_tokens) for t in texts], batch_tokens):
                found, failed = score_or_halve(scorer, [texts[i] for i in places])
                for i, (label, score), bad in zip(places, found, failed):
                    labels[i], scores[i], errors[i] = label, score, bad
            yield pdf.assign(_raw_label=labels, **{CONFIDENCE_COL: scores, ERROR_COL: errors})

    scored = df.select(*names).mapInPandas(run, out_schema)
    return scored.withColumn(SENTIMENT_COL, normalise_label(F.col("_raw_label"))).drop("_raw_label")


def sentiment_stats(df: DataFrame) -> DataFrame:
    """Label distribution with the mean confidence (3 dp) of all scored rows."""
    per = df.groupBy(SENTIMENT_COL).agg(F.count(F.lit(1)).alias("count"),
                                        F.sum(CONFIDENCE_COL).alias("_s"), F.count(CONFIDENCE_COL).alias("_c"))
    # at most four aggregated rows (three labels and null): totals by window, no second scan
    w = Window.partitionBy()
    return (per.withColumn("mean_confidence", F.round(F.sum("_s").over(w) / F.sum("_c").over(w), 3))
            .where(F.col(SENTIMENT_COL).isNotNull()).drop("_s", "_c"))


# -------------------------------------------------------------------- MLlib --

def _train_on_terms(words: PipelineModel, stages: list, train: DataFrame) -> list:
    """``stages`` fitted on the labels and term counts that ``words`` makes of all rows of ``train``.

    Every stage but the first and each step of the regression read the same rows, so the texts are read
    and tokenised once and their term counts written: no row of them has to stay in memory, and the loss of an
    executor costs no second tokenising.  The table is dropped when the fit has ended.
    """
    spark = train.sparkSession
    terms, path = words.transform(train).select("_label", "_tf"), table_path(spark, f"training-{uuid.uuid4().hex}")
    try:
        terms.write.option("compression", "zstd").parquet(path)
        return Pipeline(stages=stages).fit(spark.read.schema(terms.schema).parquet(path)).stages
    finally:
        drop_table(spark, path)


def train_sentiment_model(df: DataFrame, text_col: str = "review_text", label_col: str = "sentiment_label",
                          num_features: int = 1 << 18, max_iter: int = 20, reg_param: float = 0.01,
                          max_rows: int | None = None, key: Sequence[str] | None = None) -> PipelineModel:
    """Fit tokenise -> stop words -> hashing TF -> IDF -> multinomial logistic
    regression on the rating-derived labels.  Training is distributed by MLlib.

    Labels, document frequencies and coefficients come from every labelled row.  Only a
    caller that asks for ``max_rows`` gets a fit on so many of them: an exact sample in the
    order of a hash of ``key`` (default: text and label), the same rows whatever the
    partitioning and without sorting them in one place.
    """
    named = list(key) if key else []
    train = df.where(F.col(label_col).isNotNull()).select(
        F.coalesce(F.col(text_col), F.lit("")).alias("_text"), F.col(label_col).alias("_label"), *named)
    if max_rows is not None:
        train = exact_sample(train, max_rows, named or ["_text", "_label"])
    words = [
        RegexTokenizer(inputCol="_text", outputCol="_tok", pattern="[^a-zA-Z]+", toLowercase=True, minTokenLength=2),
        StopWordsRemover(inputCol="_tok", outputCol="_words"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
    ]
    stages = [
        StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc"),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_y", family="multinomial",
                           maxIter=max_iter, regParam=reg_param, probabilityCol="_prob",
                           predictionCol="_pred", rawPredictionCol="_raw"),
    ]
    indexer, *rest = _train_on_terms(PipelineModel(stages=words), stages, spread(train.select("_text", "_label")))
    return PipelineModel(stages=[indexer, *words, *rest])


def score_with_model(model: PipelineModel, df: DataFrame, text_col: str = "review_text") -> DataFrame:
    """Apply a fitted pipeline: label = most probable class, confidence = its probability."""
    labels = F.array(*[F.lit(label) for label in model.stages[0].labels])
    base = df.drop(SENTIMENT_COL, CONFIDENCE_COL).withColumn("_text", F.coalesce(F.col(text_col), F.lit("")))
    # the label indexer is only needed for training; skip it when scoring.  Only probabilities are made row by row:
    # the first greatest one is the prediction, so raw predictions, their places and labels need no function calls
    classifier = model.stages[-1].copy().setRawPredictionCol("").setPredictionCol("")
    scored = PipelineModel(stages=[*model.stages[1:-1], classifier]).transform(base)
    scored = scored.withColumn("_prob", vector_to_array(F.col("_prob"))).withColumn(CONFIDENCE_COL, F.array_max("_prob"))
    place = F.array_position(F.col("_prob"), F.col(CONFIDENCE_COL)).cast("int")
    return (scored.withColumn(SENTIMENT_COL, normalise_label(F.element_at(labels, place)))
            .drop("_text", "_tok", "_words", "_tf", "_features", "_prob"))


def publish_model(model: PipelineModel, path: str) -> versions.Version:
    """Save a fitted pipeline as the next version of ``path``."""
    spark = SparkSession.getActiveSession()

    def write(_frame: DataFrame, location: str) -> int:
        model.write().overwrite().save(location)
        return len(model.stages)

    return versions.publish(spark.range(0), path, fmt="mllib", write=write)


def load_model(spark: SparkSession, path: str, number: int | None = None) -> PipelineModel:
    """The current version of a saved pipeline, or the one with this number."""
    return PipelineModel.load(versions.find(spark, path, number).location)
