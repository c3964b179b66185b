"""Pattern packing: the fit, the recipe, and whole round trips of the pieces."""

import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from review_insights.llm import pattern_packing as pp
from review_insights.llm import queries

WORDS = [f"w{k}" for k in range(300)]


@pytest.fixture(scope="module")
def ids_of():
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


def check(pieces, rows, ids_of, capacity):
    """Every piece is the one the cutting rule names, no gap, no overfull sequence; returns the number of sequences."""
    wanted = Counter()
    for doc_id, text in rows:
        ids = np.array([*ids_of(text or ""), 2], "<u4")
        for piece, (start, length) in enumerate(pp.cuts(len(ids), capacity)):
            wanted[(doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes()))] += 1
    assert Counter((p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces) == wanted
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    for parts in sequences.values():
        fill = 0
        for offset, length in sorted(parts):
            assert offset == fill
            fill += length
        assert fill <= capacity
    return len(sequences)


def best_fit(lengths, capacity):
    """Best fit decreasing, one piece after the other."""
    bins = []
    for s in sorted(lengths, reverse=True):
        fits = [b for b in bins if b[0] >= s]
        if fits:
            least = min(fits, key=lambda b: b[0])
        else:
            bins.append(least := [capacity])
        least[0] -= s
    return len(bins)


@pytest.mark.parametrize("n, cuts", [(1, [(0, 1)]), (10, [(0, 10)]), (11, [(0, 1), (1, 10)]), (20, [(0, 10), (10, 10)]),
                                     (25, [(0, 5), (5, 10), (15, 10)])])
def test_cuts(n, cuts):
    assert pp.cuts(n, 10) == cuts


def test_patterns():
    found = {tuple(p) for p in pp.patterns_of(np.array([2, 3, 5, 8]), 10).tolist()}
    assert found == {(0, 2, 8), (0, 5, 5), (2, 3, 5)}
    assert (3, 3, 3) in {tuple(p) for p in pp.patterns_of(np.array([3]), 10, slack=1).tolist()}


def test_least_squares_meets_the_conditions_of_its_optimum():
    """Counts are not negative, used columns have gradient zero, no other column would help."""
    rng = np.random.default_rng(1)
    for _ in range(20):
        lengths = np.unique(rng.integers(1, 30, 14))
        patterns = pp.patterns_of(lengths, 30, slack=3)
        if not len(patterns):
            continue
        parts = np.where(patterns > 0, np.searchsorted(lengths, patterns), -1)
        target = rng.integers(1, 200, len(lengths)).astype(float)
        x = pp.non_negative_least_squares(parts, target, np.ones(len(lengths)))
        a = np.zeros((len(lengths), len(parts)))
        for j, p in enumerate(parts):
            for s in p[p >= 0]:
                a[s, j] += 1
        rest = target - a @ x
        assert (x >= 0).all()
        if np.abs(rest).max() >= 0.5:
            gradient = a.T @ rest
            assert (gradient <= 1e-3 * target.max()).all() and np.abs(gradient[x > 1e-6]).max(initial=0) <= 1e-3 * target.max()


@pytest.mark.parametrize("name", ["uniform", "short", "one", "hot", "halves"])
def test_recipes_use_every_piece_once_in_few_sequences(name):
    rng = np.random.default_rng(2)
    lengths = {"uniform": rng.integers(1, 128, 4000), "short": rng.integers(2, 9, 3000), "one": np.full(7, 50),
               "hot": np.concatenate([np.full(1500, 90), rng.integers(1, 128, 3000)]), "halves": np.full(9, 64)}[name]
    counts = {int(s): int(c) for s, c in zip(*np.unique(lengths, return_counts=True))}
    patterns = pp.fit_patterns(counts, 128)
    used = Counter()
    for pattern, repeats in patterns:
        assert sum(pattern) <= 128 and repeats > 0
        for s in pattern:
            used[s] += repeats
    assert used == counts
    assert sum(r for _, r in patterns) <= 1.01 * best_fit(lengths.tolist(), 128) + 1
    recipe = pp.Recipe(patterns)
    seen = defaultdict(list)
    for s, c in counts.items():
        sequence, offset = recipe.place(np.full(c, s), np.arange(c))
        for q, o in zip(sequence.tolist(), offset.tolist()):
            seen[q].append((o, s))
    assert len(seen) == recipe.sequences
    for parts in seen.values():
        fill = 0
        for o, s in sorted(parts):
            assert o == fill
            fill += s


def test_residuals_as_one_by_one():
    rng = np.random.default_rng(3)
    for _ in range(100):
        capacity = int(rng.integers(2, 40))
        lengths = rng.integers(1, capacity, rng.integers(1, 80)).tolist()
        assert sum(r for _, r in pp.best_fit_decreasing(Counter(lengths), capacity)) == best_fit(lengths, capacity)


def test_edges(spark, ids_of):
    rng = random.Random(4)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    rows = [(1, None), (2, ""), (None, text(40)), (3, "same text"), (3, "same text"), (4, text(20_000)), (5, "x" * 5000), (6, "a <|endoftext|> b"),
            *((k, text(rng.randint(1, 60))) for k in range(10, 200)), *((k, "hot length") for k in range(200, 400))]
    df = spark.createDataFrame([(*r, 7, "z") for r in rows], "doc_id long, text string, length int, sequence_id string").repartition(5)
    n = check(pp.pack_patterns(df, capacity=64).collect(), rows, ids_of, 64)
    lengths = [length for _, t in rows for _, length in pp.cuts(len(ids_of(t or "")) + 1, 64)]
    assert n <= 1.02 * best_fit(lengths, 64) + 1
    assert pp.pack_patterns(df.limit(0)).count() == 0


def test_query(spark, sf_small, ids_of):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{sf_small}/documents.parquet'").fetchall()
    n = check(queries.QUERIES["op13_pattern_packing"](spark, sf_small).collect(), rows, ids_of, 1024)
    lengths = [length for _, t in rows for _, length in pp.cuts(len(ids_of(t or "")) + 1, 1024)]
    assert n <= 1.02 * best_fit(lengths, 1024) + 1
