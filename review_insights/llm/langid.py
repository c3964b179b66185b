"""Language identification by averaged hashed subword embeddings and a linear softmax.

A text is the bag of character n-grams (``ORDERS``) of its lower-cased letters,
every other character being a boundary.  Each n-gram has an embedding in a
hashed table; their average goes through a linear softmax.  Table and softmax
are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows (``max_per_class`` a language, by the order of a hash
of the id; every language has its rows, however many there are).  A tenth of the sample is kept out of the descent and sets the
temperature that calibrates the probabilities and the rejection threshold:
``accepted`` is false below the score that all but ``REJECT_SHARE`` of the right
calibration answers reach.

Prediction runs over whole texts in Arrow batches.  As the softmax is linear,
the model is shipped as one row of scores a bucket (``2 ** HASH_BITS`` rows by
the number of languages), broadcast; no text is shuffled.  Long texts are worked on
in blocks.

Defined results: ``und`` with score 0 for a null text or one without letters;
repeated rows are predicted each; without any labelled row every text is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_insights.llm.common import small_enough

UNDETERMINED = "und"
HASH_BITS = 18
ORDERS = (1, 2, 3, 4)
DIMENSIONS = 16
MAX_PER_CLASS = 1500
MAX_ROWS = 60_000    # of the sample, shared out equally where there are many languages
LEAST_PER_CLASS = 20
BLOCK_CHARS = 1 << 18
GATHERED = 1 << 22   # scores gathered at once; beyond, n-grams are counted by bucket
EPOCHS = 4
MIN_STEPS = 4000     # small samples are gone through more often
LEARNING_RATE = 0.5
REJECT_SHARE = 0.01

_STEP = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xD6E8FEB86659FD93)
_GAP = regex.compile(r"\P{L}+")
_CUT = regex.compile(r"[\s\d]")


def subwords(text: str) -> np.ndarray:
    """Buckets of all character n-grams inside ' word ' frames; empty without letters."""
    parts = list(subword_blocks(text))
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def subword_blocks(text: str) -> Iterator[np.ndarray]:
    """:func:`subwords` of about ``BLOCK_CHARS`` characters at a time.  A long text is cut at white space or
    digits, which no n-gram holds and which never change how a letter is lower-cased."""
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK_CHARS:
            cut = _CUT.search(text, at + BLOCK_CHARS)
            end = cut.start() if cut else end
        found = _subwords(text[at:end])
        if len(found):
            yield found
        at = end


def _subwords(text: str) -> np.ndarray:
    framed = " " + _GAP.sub(" ", text.lower()) + " "
    codes = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    blank = codes == 32
    if blank.all():
        return np.zeros(0, np.int64)
    h = np.zeros(len(codes), np.uint64)
    inner = np.cumsum(blank)
    found = []
    for n in ORDERS:
        if n > len(codes):
            break
        h = h[:len(codes) - n + 1] * _STEP + codes[n - 1:] + np.uint64(n)
        # a blank may stand first or last in an n-gram, never inside, and never alone
        mid = inner[n - 2:len(codes) - 1] - inner[:len(codes) - n + 1] if n > 2 else np.zeros(len(h), np.int64)
        ok = mid == 0
        if n <= 2:
            ok &= ~blank[:len(h)] | (~blank[n - 1:] if n == 2 else False)
        found.append((((h ^ (h >> np.uint64(29))) * _TURN) >> np.uint64(64 - HASH_BITS))[ok])
    return np.concatenate(found).astype(np.int64)


def has_letter(text: str) -> bool:
    return regex.search(r"\p{L}", text) is not None


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray        # scores of each bucket for each language
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def parts(self) -> tuple:
        return self.languages, self.table, self.bias, self.temperature, self.threshold


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def logits(table: np.ndarray, bias: np.ndarray, text: str) -> np.ndarray:
    """Mean scores of the text's n-grams; memory for one block of it, whatever the number of languages."""
    total, n = np.zeros(len(bias)), 0
    for b in subword_blocks(text):
        n += len(b)
        if len(b) * len(bias) <= GATHERED:
            total += table[b].sum(axis=0, dtype=np.float64)
        else:
            count = np.bincount(b, minlength=len(table))
            for lo in range(0, len(table), 1 << 14):
                total += count[lo:lo + (1 << 14)].astype(np.float64) @ table[lo:lo + (1 << 14)]
    return total / n + bias if n else bias.astype(np.float64)


def predict(model: tuple, text: str | None) -> tuple[str, float, bool]:
    """``(language, score, accepted)`` of one text."""
    languages, table, bias, temperature, threshold = model
    if not languages or text is None or not has_letter(text):
        return UNDETERMINED, 0.0, False
    p = softmax(logits(table, bias, text) / temperature)
    best = int(np.argmax(p))
    return languages[best], float(p[best]), bool(p[best] >= threshold)


def fit(texts: list[str], langs: list[str], seed: int = 5) -> LanguageModel:
    languages = sorted(set(langs))
    if not languages:
        return LanguageModel([], np.zeros((1, 0), np.float32), np.zeros(0, np.float32))
    y = np.array([languages.index(lang) for lang in langs])
    bags = [np.unique(subwords(t), return_counts=True) for t in texts]
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / DIMENSIONS, (1 << HASH_BITS, DIMENSIONS)).astype(np.float32)
    out = np.zeros((DIMENSIONS, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    usable = np.array([i for i, (b, _) in enumerate(bags) if len(b)], np.int64)
    order = rng.permutation(usable)
    held, train = order[:len(order) // 10], order[len(order) // 10:]
    epochs = max(EPOCHS, -(-MIN_STEPS // max(len(train), 1)))
    steps, done = epochs * max(len(train), 1), 0
    for _ in range(epochs):
        for i in rng.permutation(train):
            rate = LEARNING_RATE * (1 - done / steps)
            done += 1
            b, c = bags[i]
            share = (c / c.sum()).astype(np.float32)
            mean = share @ emb[b]
            gap = softmax(mean @ out + bias)
            gap[y[i]] -= 1
            back = out @ gap
            out -= rate * np.outer(mean, gap)
            bias -= 0.1 * rate * gap
            # step by presence: rare n-grams of a long text are not starved by its length
            emb[b] -= rate * np.sqrt(share)[:, None] * back
    table = emb @ out
    model = LanguageModel(languages, table, bias)
    if len(held):
        z = np.array([(c / c.sum()) @ table[b] + bias for b, c in (bags[i] for i in held)], np.float64)
        grid = np.geomspace(0.25, 5.0, 60)
        loss = [-np.log(softmax(z / t)[np.arange(len(held)), y[held]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = softmax(z / model.temperature)
        right = p.argmax(axis=1) == y[held]
        model.threshold = float(np.quantile(p.max(axis=1)[right], REJECT_SHARE)) if right.any() else 0.0
    return model


def training_sample(docs: DataFrame, train: Column, max_per_class: int = MAX_PER_CLASS, id_col: str = "doc_id",
                    text_col: str = "text", lang_col: str = "lang", max_rows: int = MAX_ROWS) -> tuple[list[str], list[str]]:
    """Texts and languages of rows of every language, at most ``max_per_class`` each; where these would be more
    than ``max_rows``, an equal share for each, but ``LEAST_PER_CLASS``.  ``train`` is a condition on ``id``.

    Three reads of the table: the languages, the ids (a top-k in two levels, so no language meets in one task),
    and the texts of the ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"))
    known = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & train)
    languages = known.select("lang").distinct().count()
    if languages == 0:
        return [], []
    each = min(max_per_class, max(max_rows // languages, LEAST_PER_CLASS))
    order = [F.xxhash64("id"), F.col("id")]
    place = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(64))).orderBy(*order))
    near = known.withColumn("_place", place).where(F.col("_place") <= each)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    picked = near.withColumn("_place", place).where(F.col("_place") <= each).select("id", "lang").distinct()
    chosen = spark.createDataFrame([(r["id"], r["lang"]) for r in picked.collect()], "id long, lang string")
    found = (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                         F.col(lang_col).cast("string").alias("lang"))
             .where("text IS NOT NULL").join(small_enough(chosen), ["id", "lang"]).collect())
    found.sort(key=lambda r: (r["id"], r["lang"], r["text"]))
    return [r["text"] for r in found], [r["lang"] for r in found]


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted`` for every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = shared.value
        for batch in batches:
            rows = [predict(parts, t) for t in batch.column("text").to_pylist()]
            lang, score, accepted = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(accepted, pa.bool_())], names=["doc_id", "lang_pred", "score", "accepted"])

    return source.mapInArrow(run, "doc_id long, lang_pred string, score double, accepted boolean")
