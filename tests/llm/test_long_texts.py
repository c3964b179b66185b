"""Scores of long texts: in blocks as in one piece, in bounded memory; scores against plain Python."""

import random
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from review_insights.llm import langid, toxicity

ALPHABET = ["a", "B", "é", "ß", "Σ", "İ", "ς", "1", "'", ".", " ", "  ", "\n", " ", "\x1c", "中", "文", "ǅ", "-"]


def text_of(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


@pytest.mark.parametrize("module, of", [(langid, lambda t: np.sort(langid.subwords(t))), (toxicity, lambda t: np.sort(toxicity.ngram_buckets(t)))])
def test_blocks_equal_one_piece(monkeypatch, module, of):
    rng = random.Random(1)
    for _ in range(300):
        text = text_of(rng, rng.randint(0, 300))
        monkeypatch.setattr(module, "BLOCK_CHARS", 1 << 18)
        whole = of(text)
        monkeypatch.setattr(module, "BLOCK_CHARS", rng.randint(5, 60))
        assert np.array_equal(of(text), whole), ascii(text)


def hashed(codes, bits):
    h, mask = 0, (1 << 64) - 1
    for n, c in enumerate(codes, 1):
        h = (h * 0x9E3779B97F4A7C15 + c + n) & mask
    return (((h ^ (h >> 29)) * 0xD6E8FEB86659FD93) & mask) >> (64 - bits)


def test_toxicity_scores_in_plain_python():
    rng = random.Random(2)
    model = toxicity.fit(["you idiot go away", "nice day today", "what an idiot", "lovely day"] * 10, [1, 0, 1, 0] * 10)
    for _ in range(200):
        text = text_of(rng, rng.randint(0, 80)) + rng.choice(["idiot", " day", ""])
        padded = " " + " ".join(text.lower().split()) + " "
        seen = {hashed([ord(c) for c in padded[k:k + n]], 20) for n in (2, 3, 4, 5, 6) for k in range(len(padded) - n + 1)} if text else set()
        z = model.bias + sum(float(model.weights[b]) for b in seen)
        assert abs(model.score(text) - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-9


def test_language_scores_in_plain_python(monkeypatch):
    rng = random.Random(3)
    model = langid.fit(["the cat and the dog " * 5] * 20 + ["der hund und die katze " * 5] * 20, ["en"] * 20 + ["de"] * 20)
    for _ in range(200):
        text = text_of(rng, rng.randint(1, 80)) + " the dog"
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        found = []
        for word in words:
            framed = f" {word} "
            found += [hashed([ord(c) for c in framed[k:k + n]], 18) for n in (1, 2, 3, 4) for k in range(len(framed) - n + 1) if framed[k:k + n].strip()]
        z = np.mean([model.table[b].astype(float) for b in found], axis=0) + model.bias
        for gathered in (1 << 22, 1):
            monkeypatch.setattr(langid, "GATHERED", gathered)
            assert np.allclose(langid.logits(model.table, model.bias, text), z, atol=1e-6), ascii(text)


_MEASURE = """
import resource, sys
sys.path.insert(0, {root!r})
import numpy as np
from review_insights.llm import langid, toxicity
text = "some words of a text that goes on, " * (60_000_000 // 35)
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
if {name!r} == "toxicity":
    toxicity.score_text(np.zeros(1 << 20, np.float32), 0.0, text)
else:
    langid.logits(np.zeros((1 << 18, 40), np.float32), np.zeros(40, np.float32), text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


@pytest.mark.parametrize("name", ["toxicity", "langid"])
def test_memory_of_a_text_of_60_mb(name):
    root = __file__.rsplit("/tests/", 1)[0]
    out = subprocess.run([sys.executable, "-c", _MEASURE.format(root=root, name=name)], capture_output=True, text=True, timeout=600, check=True)
    assert float(out.stdout) < 600  # MB above the text itself


def test_every_language_has_its_rows(spark):
    """More languages than shares: none is left out; the sample does not depend on the partitioning."""
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"),
                                  F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 600).cast("string"))).alias("lang"))
    samples = []
    for parts in (1, 5):
        texts, langs = langid.training_sample(df.repartition(parts), F.lit(True), max_rows=1000)
        samples.append(sorted(zip(texts, langs)))
        assert len(set(langs)) == df.select("lang").distinct().count() > 400
        assert max(langs.count(x) for x in set(langs)) == langid.LEAST_PER_CLASS
    assert samples[0] == samples[1]
    assert langid.training_sample(df.where("false"), F.lit(True)) == ([], [])
