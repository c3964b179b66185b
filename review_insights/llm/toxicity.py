"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes
log-count ratios.

Training (on the driver, on a bounded sample of labelled rows).  A document is
the set of its hashed character n-grams.  For every bucket the log-count ratio
``r = ln((1 + toxic docs) / (2 + all toxic docs)) - ln((1 + clean docs) / (2 + all clean docs))``
is taken over the sample; the features of the logistic model are
``r * presence`` and their weights are fitted by stochastic gradient descent
with per-weight step sizes.  ``fit(...).weights`` is the product of both, so
scoring needs one table look-up per n-gram.

Scoring runs over every whole text in Arrow batches: the model (one float per
bucket, a fixed size) is broadcast, nothing is shuffled.

Bounds, all parameters: at most ``max_per_class`` labelled documents of each
class, taken by the order of a hash of their id; ``2 ** HASH_BITS`` buckets.

Defined results: null and empty texts have no n-gram and get the score of the
bias alone; every row is scored, repeated rows alike.  A sample without both
classes gives score 0 for all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HASH_BITS = 20
ORDERS = (2, 3, 4, 5, 6)
MAX_PER_CLASS = 2500
MIN_DOCS = 4
MIN_RATIO = 0.5      # n-grams about as common in both classes say nothing
EPOCHS = 8
THRESHOLD = 0.7
BLOCK_CHARS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_SPACE = re.compile(r"\s")


def ngram_buckets(text: str) -> np.ndarray:
    """Distinct buckets of the character n-grams of a lower-cased text; runs of
    white space count as one space, and the text is padded by one.  A long text is
    worked on in blocks, cut at white space, that overlap by an n-gram."""
    if not text:
        return np.zeros(0, np.int64)
    if len(text) <= BLOCK_CHARS:
        found = _all_buckets(" " + " ".join(text.lower().split()) + " ")
        return distinct(found) if len(found) else found
    flags = np.zeros(1 << HASH_BITS, bool)
    carried, at = "", 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK_CHARS:
            cut = _SPACE.search(text, at + BLOCK_CHARS)
            end = cut.start() if cut else end
        words = text[at:end].lower().split()
        if words:
            block = carried + " " + " ".join(words)
            flags[_all_buckets(block)] = True
            carried = block[1 - max(ORDERS):]
        at = end
    flags[_all_buckets((carried or " ") + " ")] = True
    return np.flatnonzero(flags)


def _all_buckets(padded: str) -> np.ndarray:
    codes = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes), np.uint64)
    found = []
    for n in range(1, max(ORDERS) + 1):
        if n > len(codes):
            break
        h = h[:len(codes) - n + 1] * _STEP + codes[n - 1:] + np.uint64(n)
        if n in ORDERS:
            found.append(((h ^ (h >> np.uint64(29))) * _TURN) >> np.uint64(64 - HASH_BITS))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


_LAST: dict[str, np.ndarray] = {}


def distinct(buckets: np.ndarray) -> np.ndarray:
    """Distinct values without sorting: the last place of each bucket marks it."""
    last = _LAST.get("last")
    if last is None:
        last = _LAST["last"] = np.zeros(1 << HASH_BITS, np.int32)
    place = np.arange(len(buckets), dtype=np.int32)
    last[buckets] = place
    return buckets[last[buckets] == place]


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        return score_text(self.weights, self.bias, text)


def score_text(weights: np.ndarray, bias: float, text: str | None) -> float:
    z = bias + float(weights[ngram_buckets(text or "")].sum(dtype=np.float64))
    return float(1.0 / (1.0 + np.exp(-np.clip(z, -30.0, 30.0))))


def fit(texts: list[str], toxic: list[int], seed: int = 7) -> ToxicityModel:
    """Log-count ratios, then logistic regression on the scaled features."""
    size = 1 << HASH_BITS
    y = np.asarray(toxic, np.float64)
    if len(y) == 0 or y.min() == y.max():
        return ToxicityModel(np.zeros(size, np.float32), -30.0)
    n_toxic = np.zeros(size, np.float32)
    n_clean = np.zeros(size, np.float32)
    for t, label in zip(texts, y):
        (n_toxic if label else n_clean)[ngram_buckets(t or "")] += 1
    ratio = np.log((1 + n_toxic) / (2 + y.sum())) - np.log((1 + n_clean) / (2 + (1 - y).sum()))
    ratio[(n_toxic + n_clean < min(MIN_DOCS, max(1, y.sum() // 4))) | (np.abs(ratio) < MIN_RATIO)] = 0.0
    docs = []
    for t in texts:  # the n-grams are made twice rather than held
        d = ngram_buckets(t or "")
        docs.append(d[ratio[d] != 0].astype(np.int32))

    rng = np.random.default_rng(seed)
    v = np.zeros(size)
    squares = np.full(size, 1e-8)
    bias, bias_squares = -1.0, 1e-8
    share = y.mean()
    cost = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            d = docs[i]
            r = ratio[d]
            z = bias + float(v[d] @ r)
            g = (1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y[i]) * cost[i]
            bias_squares += g * g
            bias -= 0.1 * g / np.sqrt(bias_squares)
            if len(d):
                step = g * r / np.sqrt(max(1.0, float(r @ r)))
                squares[d] += step * step
                v[d] -= 0.05 * step / np.sqrt(squares[d])
    return ToxicityModel((v * ratio).astype(np.float32), float(bias))


def training_sample(docs: DataFrame, labels: DataFrame, train: Column, max_per_class: int = MAX_PER_CLASS,
                    id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of at most ``max_per_class`` documents of each class.

    The ids are picked from the labels alone (hash order, bounded), so only
    texts of the sample leave the scan of ``docs``.
    """
    spark = docs.sparkSession
    known = (labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
             .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)))
    picked = None
    for label in (0, 1):
        part = (known.where((F.col("label") == label) & train).orderBy(F.xxhash64("id"), "id").limit(max_per_class))
        picked = part if picked is None else picked.unionByName(part)
    rows = [(r["id"], r["label"]) for r in picked.collect()]
    chosen = spark.createDataFrame(rows, "id long, label int")
    found = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(chosen), "id").select("id", "text", "label").collect())
    found.sort(key=lambda r: (r["id"], r["text"] or "", r["label"]))
    return [r["text"] or "" for r in found], [r["label"] for r in found]


def _scorer(shared, schema: pa.Schema, text_at: int, emit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            yield emit(batch, np.array([score_text(weights, bias, t) for t in texts], np.float64), schema)
    return run


def _with_scores(batch: pa.RecordBatch, scores: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], schema=schema)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row of ``docs``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    return source.mapInArrow(_scorer(shared, schema, 1, _with_scores), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored at ``threshold`` or more, columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def keep(batch: pa.RecordBatch, scores: np.ndarray, _schema) -> pa.RecordBatch:
        return batch.filter(pa.array(scores < threshold))

    at = docs.columns.index(text_col)
    return docs.mapInArrow(_scorer(shared, None, at, keep), docs.schema)
