"""Phrase mining against plain Python with whole numbers."""

import random
import re
from collections import Counter

import pytest

from review_insights.llm import phrase_mining as pm

SCHEMA = "doc_id long, text string, lang string, phrase string, id long, block int"


def plain(rows, max_words=3, least=10, top=2000, share=50):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for m in range(1, max_words + 1):
                counts.setdefault(lang, Counter()).update(tuple(words[k:k + m]) for k in range(len(words) - m + 1))
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        around = Counter()
        for p, a in candidates.items():
            for m in range(2, len(p)):
                for k in range(len(p) - m + 1):
                    around[p[k:k + m]] = max(around[p[k:k + m]], a)
        ranked = []
        for p, a in candidates.items():
            if around[p] and 100 * around[p] >= share * a:
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "BETA", "gamma", "é", "ÉTÉ", "x y", "中文", "d-e", "f'g", "#", "zeta"]
    marks = [" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "! ", "\r\n", "\x0b", " \x0c", "?", ";:"]
    rows = [("".join(rng.choice(words[:rng.randint(2, 12)]) + rng.choice(marks) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None, "und", ""]))
            for _ in range(150)]
    rows += [(None, "en"), ("", "de"), (" \t ", None), ("...\n", "only ends"), ("a a a a a a a a a a a a a", "aa"), ("one", "short")]
    rows += [("New York City is New York. " * 30, "en"), ("same row again", "en"), ("same row again", "en")]
    rows += [(" ".join(rng.choice(["p", "q", "r"]) for _ in range(20_000)), "long piece")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, t, g, "x", 1, 2) for k, (t, g) in enumerate(rows)], SCHEMA).repartition(4)


@pytest.mark.parametrize("max_words, least, top, share, block_bytes", [(3, 10, 2000, 50, 8 << 20), (3, 10, 7, 50, 500), (2, 5, 2000, 50, 3_000),
                                                                       (5, 3, 2000, 80, 2_000)])
def test_phrases_equal_plain_python(spark, max_words, least, top, share, block_bytes):
    rows = corpus(max_words)
    found = pm.mine_phrases(frame(spark, rows), max_words=max_words, least=least, top=top, inside_share=share, block_bytes=block_bytes)
    assert sorted(map(tuple, found.collect())) == plain(rows, max_words, least, top, share)


def test_empty_table(spark):
    assert pm.mine_phrases(frame(spark, []).limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = [(10**13 + 7, [3 * 10**13 + 1, 10**13 + 7], [2 * 10**13 + 9, 10**13 + 7]), (999_999_999_999, [10**12 + 3, 999_999_999_999], [10**15 + 1, 999_999_999_999])]
    df = spark.createDataFrame(rows, "f long, first_counts array<long>, last_counts array<long>")
    found = [r["cut"]["score"] for r in df.select(pm._lowest_cut(2).alias("cut")).collect()]
    assert found == [1_000_000 * a * a // (x[0] * y[0]) for a, x, y in rows]


def test_cuts_that_tie_take_the_smallest(spark):
    df = spark.createDataFrame([(10, [20, 40, 10], [40, 80, 10])], "f long, first_counts array<long>, last_counts array<long>")
    cut = df.select(pm._lowest_cut(3).alias("cut")).collect()[0]["cut"]
    assert 20 * 80 == 40 * 40 and (cut["k"], cut["l"], cut["r"]) == (1, 20, 80)


def test_texts_are_cut_between_pieces_only():
    import numpy as np

    rng = random.Random(5)
    for _ in range(200):
        text = np.frombuffer("".join(rng.choice("ab .\n") if rng.random() < 0.3 else "c" for _ in range(rng.randint(0, 200))).encode(), np.uint8)
        parts = list(pm._whole_pieces(text, 16))
        assert b"".join(p.tobytes() for p in parts) == text.tobytes()
        assert all(p[-1] in b".\n" for p in parts[:-1])


def test_no_group_of_a_language_is_gathered(spark):
    """The ranking by language reads at most ``top`` rows of every bucket."""
    plan = pm.mine_phrases(frame(spark, corpus(1)), block_bytes=2_000)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") == 2 and "pmod(hash(phrase" in plan
