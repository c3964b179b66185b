"""Pattern packing by non-negative least squares.

Documents become pieces of at most ``capacity`` tokens: a longer document is
cut into whole windows behind a first piece that holds the remainder.  A whole
window is a sequence of its own.  All shorter pieces are packed by the lengths
they have, in four steps:

1. histogram: how many pieces have each length (fewer than ``capacity`` numbers);
2. patterns: every combination of two or three lengths of the histogram that
   fills a sequence but for ``slack`` tokens, the third length being the largest
   that fits;
3. fit: repeat counts ``x >= 0`` of the patterns such that the pieces they use
   come closest to the histogram in the (weighted) least-squares sense, by Lawson
   and Hanson's active set, several columns at a time, which leaves at most as
   many patterns in use as there are lengths;
4. rounding: counts become whole numbers, never using more pieces than there
   are, and the residual pieces are packed best fit decreasing, length by
   length, which gives further patterns with repeat counts.

The result is a recipe: for every length, which rank of a piece goes to which
sequence and place.  Pieces are ranked among those of their length by the task
that cut them and a counter there, so no length is gathered anywhere.

Scale: the driver sees the histogram only.  One pass over the texts writes the
pieces (without ids) to the shared checkpoint folder; one partial aggregate and
a join on (task, length) give the ranks, and a map step with the recipe (bounded
by the capacity, a few numbers a pattern) places them.  A length that holds a
third of all pieces is spread over as many keys as tasks cut pieces.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null id stays null; extra columns are not read; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from review_insights.llm.common import partition_id, saved
from review_insights.llm.packing import Encoder, default_paths

CAPACITY = 1024
END_ID = 2
#: Tokens a pattern of the fit may leave empty.
SLACK = 0
#: Columns that enter the active set at once, and steps after which the fit ends.
AT_ONCE, ROUNDS = 128, 120
#: Errors of the fit weigh by (length / capacity) to this power: a long piece left over costs a sequence, a short one fills a gap.
LONG_FIRST = 6
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, k long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of ``n`` tokens: the remainder first, then whole windows."""
    first = n - capacity * ((n - 1) // capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def _cut(paths: tuple[str, str, str] | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(*(paths or default_paths())), partition_id()
        seen = np.zeros(capacity + 1, np.int64)
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                            ("ids_crc32", pa.int64()), ("task", pa.int64()), ("k", pa.int64())])
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.array([end_id], "<u4"))
                for piece, (start, length) in enumerate(cuts(len(ids), capacity)):
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:start + length].tobytes()), task, int(seen[length])))
                    seen[length] += 1
            columns = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
    return run


def patterns_of(lengths: np.ndarray, capacity: int, slack: int = SLACK) -> np.ndarray:
    """Combinations of two or three of the (sorted) lengths that fill ``capacity`` up to ``slack``:
    one row of three lengths each, ascending, 0 where there are two."""
    a, b = np.meshgrid(lengths, lengths, indexing="ij")
    a, b = a[a <= b], b[a <= b]
    fits = a + b <= capacity
    a, b = a[fits], b[fits]
    at = np.searchsorted(lengths, capacity - a - b, side="right") - 1
    c = np.where(at >= 0, lengths[np.maximum(at, 0)], 0)
    full = a + b + c >= capacity - slack
    return np.unique(np.sort(np.stack([a[full], b[full], c[full]], axis=1), axis=1), axis=0)


def non_negative_least_squares(parts: np.ndarray, target: np.ndarray, weight: np.ndarray, at_once: int = AT_ONCE,
                               rounds: int = ROUNDS) -> np.ndarray:
    """``x >= 0`` with least ``|weight * (A x - target)|``; column ``j`` of ``A`` counts the entries of
    ``parts[j]`` (indexes into ``target``, -1 for none).  Ends when every entry of the residual is below half a piece."""
    n, m = len(target), len(parts)
    x, active = np.zeros(m), np.zeros(m, bool)
    weights = np.append(weight.astype(float), 0.0)
    goal = weights[:n] * target

    def matrix(columns: np.ndarray) -> np.ndarray:
        a = np.zeros((n + 1, len(columns)))
        for slot in range(parts.shape[1]):
            np.add.at(a, (parts[columns, slot], np.arange(len(columns))), 1.0)
        return (a * weights[:, None])[:n]

    def residual() -> np.ndarray:
        out = np.append(target.astype(float), 0.0)
        used = np.flatnonzero(x)
        np.subtract.at(out, parts[used].ravel(), np.repeat(x[used], parts.shape[1]))
        out[n] = 0.0
        return out

    tolerance = 1e-7 * max(float((weights * residual()).max(initial=0.0)), 1e-9)
    several, last = at_once, np.inf
    for _ in range(rounds):
        rest = residual()
        error = float(((weights * rest) ** 2).sum())
        if np.abs(rest).max() < 0.5:
            break
        # columns that enter together can send each other out again; one alone always helps
        several = min(at_once, 2 * several) if error < last * (1 - 1e-9) else max(1, several // 2)
        last = error
        gradient = (weights ** 2 * rest)[parts].sum(axis=1)
        gradient[active] = -np.inf
        order = np.argsort(-gradient, kind="stable")[:64 * at_once]
        taken, touched = [], set()
        for j in order[gradient[order] > tolerance]:
            own = set(parts[j].tolist()) - {-1}
            if not own & touched:
                touched |= own
                taken.append(j)
                if len(taken) == several:
                    break
        if not taken:
            break
        active[taken] = True
        while active.any():
            columns = np.flatnonzero(active)
            a = matrix(columns)
            gram = a.T @ a
            gram[np.diag_indices_from(gram)] += 1e-10
            z = np.linalg.solve(gram, a.T @ goal)
            low = z <= 0
            if not low.any():
                x[columns] = z
                break
            # back to the last point where no count is negative; counts that reach zero leave
            now = x[columns]
            step = float((now[low] / (now[low] - z[low])).min())
            moved = np.maximum(now + step * (z - now), 0.0)
            moved[low & (moved <= 1e-9 * max(float(moved.max()), 1.0))] = 0.0
            x[columns] = moved
            active[columns[moved == 0.0]] = False
    return x


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Pattern and repeats of a best-fit-decreasing packing; equal bins are one entry."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    room: list[int] = []  # ascending

    def put(left: int, pattern: tuple[int, ...], repeats: int) -> None:
        if repeats:
            if left not in open_bins:
                open_bins[left] = []
                bisect.insort(room, left)
            open_bins[left].append((pattern, repeats))

    for length in sorted((s for s, c in counts.items() if c), reverse=True):
        todo = counts[length]
        while todo:
            at = bisect.bisect_left(room, length)
            if at == len(room):
                left, pattern, repeats = capacity, (), -(-todo // (capacity // length))
            else:
                left = room[at]
                pattern, repeats = open_bins[left].pop()
                if not open_bins[left]:
                    del open_bins[left]
                    room.pop(at)
            each = left // length
            whole = min(repeats, todo // each)
            put(left - each * length, pattern + (length,) * each, whole)
            todo -= whole * each
            if whole < repeats and todo:
                put(left - todo * length, pattern + (length,) * todo, 1)
                whole, todo = whole + 1, 0
            put(left, pattern, repeats - whole)
    return [entry for entries in open_bins.values() for entry in entries if entry[0]]


def fit_patterns(counts: dict[int, int], capacity: int = CAPACITY, slack: int = SLACK) -> list[tuple[tuple[int, ...], int]]:
    """``(lengths, repeats)`` that use every piece of the histogram ``{length: pieces}`` exactly once."""
    lengths = np.array(sorted(s for s, c in counts.items() if c), np.int64)
    left = {int(s): int(counts[int(s)]) for s in lengths}
    out: list[tuple[tuple[int, ...], int]] = []
    patterns = patterns_of(lengths, capacity, slack) if len(lengths) else np.zeros((0, 3), np.int64)
    if len(patterns):
        parts = np.where(patterns > 0, np.searchsorted(lengths, patterns), -1)
        x = non_negative_least_squares(parts, np.array([left[int(s)] for s in lengths], float), (lengths / capacity) ** LONG_FIRST)
        for j in np.argsort(-x, kind="stable")[:int((x >= 0.5).sum())]:
            pattern = tuple(int(s) for s in patterns[j] if s)
            repeats = min([int(np.rint(x[j])), *(left[s] // pattern.count(s) for s in set(pattern))])
            if repeats > 0:
                out.append((pattern, repeats))
                for s in pattern:
                    left[s] -= repeats
    return out + best_fit_decreasing(left, capacity)


class Recipe:
    """Sequence and offset of the ``rank``-th piece of a length."""

    def __init__(self, patterns: list[tuple[tuple[int, ...], int]]):
        taken: dict[int, int] = {}
        rows, base = [], 0
        for pattern, repeats in patterns:
            offset = 0
            for length in pattern:
                first = taken.get(length, 0)
                rows.append((length, first, base, offset))
                taken[length] = first + repeats
                offset += length
            base += repeats
        self.sequences = base
        table = np.array(sorted(rows), np.int64).reshape(-1, 4)
        self.key = (table[:, 0] << 48) + table[:, 1]
        self.first, self.base, self.offset = table[:, 1], table[:, 2], table[:, 3]

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + rank, side="right") - 1
        return self.base[at] + rank - self.first[at], self.offset[at]


def _place(recipe: Recipe, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, task, k, before = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "task", "k", "before"))
            sequence = -1 - ((task << 33) + k)  # whole windows: numbers of their own below zero
            offset = np.zeros(len(length), np.int64)
            short = length < capacity
            if short.any():
                sequence[short], offset[short] = recipe.place(length[short], before[short] + k[short])
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_patterns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
                  end_id: int = END_ID, slack: int = SLACK, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = saved(source.mapInArrow(_cut(paths, capacity, end_id), _PIECES), "pattern-pieces")
    per_task = saved(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "pattern-counts", narrow=True)
    histogram = per_task.where(F.col("length") < capacity).groupBy("length").agg(F.sum("n").alias("n"))
    recipe = Recipe(fit_patterns({r["length"]: r["n"] for r in histogram.collect()}, capacity, slack))
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).cast("long").alias("before"))
    ranked = pieces.join(before, ["task", "length"])
    return ranked.mapInArrow(_place(recipe, capacity), "doc_id long, piece int, start long, length long, ids_crc32 long, "
                             "sequence_id long, offset long")
