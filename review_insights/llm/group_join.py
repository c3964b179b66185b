"""Near duplicates by a grouped prefix join on word shingle sets (Jaccard).

Two documents link when ``den * intersection >= num * union`` of their sets of
distinct word shingles; the result is the connected component of every document.

Method
1. Order.  A global order of shingles: by a hash, except that the shingles
   found most often (the ``HEAVY`` most frequent, counted over all documents)
   come last.  Any order gives right results; this one keeps passages that many
   documents share out of the prefixes.
2. Prefix.  A set of ``n`` needs ``ceil(n * num / den)`` common shingles with
   any partner, so linked sets share one of their first
   ``n - ceil(n * num / den) + 1`` shingles.
3. Collapse.  Equal sets become one class; classes with one prefix and one
   size become one group, and only groups enter the join.
4. Group pairs from the lists of groups by prefix shingle, filtered by size and
   position; first each list against its leading groups only (a star, linear
   in the list), if they share many lists.  Lists that still hold more than one
   component are paired in blocks, filtered by size and by a bitmap bound on
   the overlap: first a spanning forest of the best pairs (linear too), then
   every pair that is left between components.
5. Expand the group pairs to class pairs, verify each on the whole texts.

Since only pairs of one component are ever left out, the components are those
of all links.  No task holds a list: stars stream over sorted rows, heavy lists
are salted, blocks are bounded.  Components come from distributed star steps.

Defined results: words are runs of bytes other than 0x20, 0x09-0x0D after
lower-casing A-Z; fewer words than a shingle form one shingle; a null, empty or
blank text has an empty set, no link and its own id as component.  Repeated
rows are equal sets.  A null id sorts after all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import (BLOCK_BYTES, BROADCAST_IDS, SpanHash, blocks, id_and_bytes, joined_bytes, mix, numbered, packed,
                                        partition_id, saved, small_enough, unpacked, unused, without_rows, words)
from review_insights.llm.components import components

HEAVY = 1 << 18          # most frequent shingles that go last in the order (size of the broadcast)
HUBS = 2                 # leading groups of a list that all its groups are held against first
EVIDENCE = 4             # such a pair is verified at once if it shares a list for every 4 prefix shingles
BUCKETS_PER_PARTITION = 2
BLOCK = 1024             # groups per block of the all-pairs step
SMALL = 64               # lists up to this size are paired together, by distance
COUNT_AT = 1_000_000     # shingles counted together inside a task
LEAST_BITS = 2048        # of the bitmap that bounds the overlap of two sets; larger sets have two bits or more an element

_POSTING = np.dtype([("tok", "<u4"), ("grp", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("heavy", "u1")])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    rows = len(offsets) - 1
    x = _LOWER[data]
    start, end, row = words(x, offsets)
    if len(start) == 0:
        return [np.zeros(0, np.uint64)] * rows
    h = SpanHash(x).of(start, end)
    per_row = np.bincount(row, minlength=rows)
    first = np.cumsum(per_row) - per_row
    short: dict[int, np.uint64] = {}
    k, n = h, len(h)
    for step in range(1, size + 1):
        if step > 1:
            k = mix(k[:max(0, n - step + 1)] * _CHAIN + h[step - 1:]) if n >= step else k[:0]
        if step < size:
            for i in np.flatnonzero(per_row == step):
                short[i] = k[first[i]]
    out = []
    for i in range(rows):
        if per_row[i] >= size:
            s = np.sort(k[first[i]:first[i] + per_row[i] - size + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        else:
            out.append(np.array([short[i]], np.uint64) if per_row[i] else np.zeros(0, np.uint64))
    return out


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (n * num + den - 1) // den + 1


def bitmap(s: np.ndarray) -> bytes:
    """The set as flags of the low bits of its hashes; the size is a power of two, so that a larger
    bitmap folds onto a smaller one."""
    bits = max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length())
    flags = np.zeros(bits, np.uint8)
    flags[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


class Bitmaps:
    """Bitmaps of several sizes; ``different`` counts the bits in which two of them differ at the smaller size."""

    def __init__(self, bits: np.ndarray):
        self.size = np.array([len(b) // 8 for b in bits], np.int64)
        self._place = np.zeros(len(bits), np.int64)
        self._folded: dict[tuple[int, int], np.ndarray] = {}
        for n in np.unique(self.size).tolist():
            at = np.flatnonzero(self.size == n)
            self._place[at] = np.arange(len(at))
            self._folded[n, n] = np.frombuffer(b"".join(bits[at]), np.uint64).reshape(-1, n)

    def _at(self, rows: np.ndarray, size: int) -> np.ndarray:
        out = np.empty((len(rows), size), np.uint64)
        for n in np.unique(self.size[rows]).tolist():
            if (n, size) not in self._folded:
                table = self._folded[n, n]
                while table.shape[1] > size:
                    half = table.shape[1] // 2
                    table = table[:, :half] | table[:, half:]
                self._folded[n, size] = table
            own = self.size[rows] == n
            out[own] = self._folded[n, size][self._place[rows[own]]]
        return out

    def different(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        size, out = np.minimum(self.size[a], self.size[b]), np.zeros(len(a), np.int64)
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            step = max(1, BLOCK_BYTES // (8 * n))
            for lo in range(0, len(at), step):
                part = at[lo:lo + step]
                out[part] = np.bitwise_count(self._at(a[part], n) ^ self._at(b[part], n)).sum(axis=1, dtype=np.int64)
        return out


def _row_sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = joined_bytes(batch.column("data"))
    for lo, hi in blocks(offsets):
        yield from enumerate(shingle_sets(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], size), lo)


def _count_often(size: int):
    """Shingles found in two or more distinct sets of a task, with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[tuple] = set()
        total = 0

        def flush() -> pa.RecordBatch:
            key, n = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            often = n >= 2
            return pa.RecordBatch.from_arrays([pa.array(key[often].view(np.int64)), pa.array(n[often].astype(np.int64))],
                                              names=["shingle", "found"])

        for batch in batches:
            for _, s in _row_sets(batch, size):
                mark = (len(s), int(mix(s).sum(dtype=np.uint64)) if len(s) else 0)
                if len(s) == 0 or mark in seen:
                    continue
                seen.add(mark)
                held.append(s)
                total += len(s)
                if total >= COUNT_AT:
                    yield flush()
                    held, seen, total = [], set(), 0
        yield flush()
    return run


def _sign(shared, size: int, num: int, den: int):
    """Per document: set size, digests of set and prefix, prefix, bitmap and compressed words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        heavy, rank = shared.value
        press = zstandard.ZstdCompressor(level=3)
        top = np.uint64(1) << np.uint64(63)
        for batch in batches:
            n, d1, d2, p1, p2, lights, bits, packed, prefixes = [], [], [], [], [], [], [], [], []
            texts = batch.column("data")
            for i, s in _row_sets(batch, size):
                n.append(len(s))
                if len(s) == 0:
                    for column in (d1, d2, p1, p2, lights):
                        column.append(0)
                    bits.append(None), packed.append(None)
                    prefixes.append(np.zeros(0, np.int32))
                    continue
                d1.append(int(mix(s).sum(dtype=np.uint64)))
                d2.append(int(mix(s ^ _CHAIN).sum(dtype=np.uint64)))
                order = s >> np.uint64(1)
                if len(heavy):
                    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                    found = heavy[at] == s
                    order[found] = top + rank[at[found]]
                length = prefix_length(len(s), num, den)
                pick = np.argpartition(order, length - 1)[:length]
                pick = pick[np.argsort(order[pick])]
                prefixes.append((s[pick] & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32))
                lights.append(int((order[pick] < top).sum()))
                p1.append(int(mix(s[pick] + _CHAIN).sum(dtype=np.uint64)))
                p2.append(int(mix(s[pick] ^ top).sum(dtype=np.uint64)))
                bits.append(bitmap(s))
                packed.append(press.compress(b" ".join(texts[i].as_py().lower().split())))
            at = np.cumsum([0] + [len(p) for p in prefixes], dtype=np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("id"), pa.array(n, pa.int32()),
                *[pa.array(np.array(c, np.uint64).view(np.int64)) for c in (d1, d2, p1, p2)],
                prefix, pa.array(lights, pa.int32()), pa.array(bits, pa.binary()), pa.array(packed, pa.binary())],
                names=["row", "id", "n", "d1", "d2", "p1", "p2", "prefix", "light", "bits", "packed"])
    return run


_SIGNED = ("row long, id long, n int, d1 long, d2 long, p1 long, p2 long, prefix array<int>, light int, bits binary, packed binary")


def least_overlap(n1, n2, num: int, den: int):
    """Common shingles that sets of these sizes need: ceil(num (n1 + n2) / (num + den))."""
    return -((-num * (n1 + n2)) // (num + den))


def _fits(n1, pos1, n2, pos2, num: int, den: int):
    """Size and position filters; a shared prefix shingle stands at ``pos`` in each order."""
    small, large = np.minimum(n1, n2), np.maximum(n1, n2)
    return (den * small >= num * large) & (np.minimum(n1 - pos1, n2 - pos2) >= least_overlap(n1, n2, num, den))


def _post(buckets: int):
    """Prefix shingles of the groups as compressed blocks, by shingle.  The lists of
    heavy shingles are dealt over all buckets, a part for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = partition_id()
        for batch in batches:
            prefix = batch.column("prefix")
            size = np.diff(prefix.offsets.to_numpy()).astype(np.int64)
            owner = np.repeat(np.arange(len(size)), size)
            rows = np.empty(len(owner), _POSTING)
            rows["tok"] = prefix.flatten().to_numpy(zero_copy_only=False).view(np.uint32)
            rows["grp"] = batch.column("cls").to_numpy()[owner]
            rows["n"] = batch.column("n").to_numpy()[owner]
            rows["pos"] = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            rows["heavy"] = rows["pos"] >= batch.column("light").to_numpy()[owner]
            bucket = (rows["tok"].astype(np.int64) + rows["heavy"] * salt) % buckets
            by = np.lexsort((rows["pos"], rows["grp"], bucket))
            rows, bucket = rows[by], bucket[by]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            found = [(k, packed(rows[edges[k]:edges[k + 1]])) for k in range(buckets) if edges[k] < edges[k + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.int32()), pa.array([d for _, d in found], pa.binary())],
                                             names=["bucket", "data"])
    return run


def _star(num: int, den: int):
    """Blocks come sorted by bucket.  Of every list of two groups or more: its rows,
    and the pairs of its leading groups with the rest (``other`` set; ``tok`` is
    the number of lists they share here, ``n`` the smaller size)."""
    def stars(held: list[bytes]) -> pa.RecordBatch:
        t = np.concatenate([unpacked(h, _POSTING) for h in held])
        t = t[np.lexsort((t["grp"], t["tok"]))]
        tok, grp, n, pos = t["tok"], t["grp"], t["n"].astype(np.int64), t["pos"].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(first, len(tok)))
        start, length = np.repeat(first, size), np.repeat(size, size)
        pairs = []
        for hub in range(HUBS):
            at = np.flatnonzero(np.arange(len(tok)) > start + hub)
            lead = start[at] + hub
            ok = _fits(n[at], pos[at], n[lead], pos[lead], num, den)
            pairs.append(np.stack([grp[lead[ok]], grp[at[ok]], np.minimum(n[lead[ok]], n[at[ok]])], axis=1))
        both, shared = np.unique(np.concatenate(pairs), axis=0, return_counts=True)
        keep = (length >= 2) | (t["heavy"] > 0)  # other parts of a heavy list may hold more
        k, p = int(keep.sum()), len(both)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([both[:, 0], grp[keep]])),
            pa.array(np.concatenate([both[:, 1], np.zeros(k, np.int64)]), mask=np.arange(p + k) >= p),
            pa.array(np.concatenate([shared, tok[keep].astype(np.int64)])),
            pa.array(np.concatenate([both[:, 2], n[keep]])),
            pa.array(np.concatenate([np.zeros(p, np.int64), pos[keep]]))], names=["grp", "other", "tok", "n", "pos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data")):
                if bucket != current and held:
                    yield stars(held)
                    held = []
                current = bucket
                held.append(data.as_py())
        if held:
            yield stars(held)
    return run


def _with_partners(num: int, den: int):
    """Of lists of up to ``SMALL`` groups (rows come sorted by ``tok``), the rows with a partner in another component
    that passes the size and position filters.  Linked groups pass in the list of their first common shingle."""
    def flags(rows: dict) -> np.ndarray:
        tok = rows["tok"]
        first = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        size = np.diff(np.append(first, len(tok)))
        stop, out = np.repeat(first + size, size), np.zeros(len(tok), bool)
        place = np.arange(len(tok))
        for step in range(1, int(size.max(initial=1))):
            place = place[place + step < stop[place]]
            a, b = place, place + step
            ok = _fits(rows["n"][a], rows["pos"][a], rows["n"][b], rows["pos"][b], num, den) & (rows["grp"][a] != rows["grp"][b])
            ok &= (rows["comp"][a] != rows["comp"][b]) | rows["mixed"][a] | rows["mixed"][b]
            out[a[ok]] = True
            out[b[ok]] = True
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = {c: table.column(c).to_numpy() for c in ("tok", "grp", "n", "pos", "comp", "mixed")}
            yield from table.filter(pa.array(flags(rows))).to_batches()

        for batch in batches:
            held.append(batch)
            table = pa.Table.from_batches(held)
            tok = table.column("tok").to_numpy()
            cut = int(np.searchsorted(tok, tok[-1])) if len(tok) else 0  # the last list may go on in the next batch
            if cut:
                yield from emit(table.slice(0, cut))
            held = table.slice(cut).combine_chunks().to_batches()
        if held:
            yield from emit(pa.Table.from_batches(held))
    return run


def _spanning(a: np.ndarray, b: np.ndarray, score: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Places of the pairs that join two of the ``group`` labels not yet joined by
    better pairs: a spanning forest, best scores first."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := parent.get(x, x)) != x:
            parent[x] = parent.get(up, up)
            x = up
        return x

    out = []
    for i in np.argsort(-score, kind="stable").tolist():
        x, y = find(int(group[a[i]])), find(int(group[b[i]]))
        if x != y:
            parent[x] = y
            out.append(i)
    return np.array(out, np.int64)


def _block_pairs(num: int, den: int, forest: bool):
    """All pairs of a block pair that lie in different components and pass the size
    and bitmap filters, or with ``forest`` a spanning forest of them and the lists
    that have any (only ``list`` set).  Rows come sorted by (list, p, q)."""
    def passing(rows: dict, maps: Bitmaps, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n1, n2 = rows["n"][a], rows["n"][b]
        ok = (den * np.minimum(n1, n2) >= num * np.maximum(n1, n2)) & (rows["grp"][a] != rows["grp"][b])
        ok &= (rows["comp"][a] != rows["comp"][b]) | rows["mixed"][a] | rows["mixed"][b]
        a, b = a[ok], b[ok]
        n = rows["n"][a] + rows["n"][b]
        most = (n - maps.different(a, b)) // 2
        ok = (most >= least_overlap(n, 0, num, den)) | ~rows["exact"][a] | ~rows["exact"][b]
        return a[ok], b[ok], most[ok] / n[ok]

    def pairs_of(rows: dict) -> pa.RecordBatch:
        total, maps = len(rows["list"]), Bitmaps(rows["bits"])
        edge = np.flatnonzero(_changes(rows))
        size = np.diff(np.append(edge, total))
        stop = np.repeat(edge + size, size)
        found = []
        small = np.repeat(size <= SMALL, size)
        place = np.flatnonzero(small)
        for step in range(1, int(size[size <= SMALL].max(initial=1))):
            place = place[place + step < stop[place]]
            found.append(passing(rows, maps, place, place + step))
        for lo, n in zip(edge[size > SMALL], size[size > SMALL]):
            part = rows["part"][lo:lo + n]
            left = lo + np.flatnonzero(part == rows["p"][lo])
            right = left if rows["p"][lo] == rows["q"][lo] else lo + np.flatnonzero(part == rows["q"][lo])
            for at in range(0, len(left), 64):
                a, b = np.repeat(left[at:at + 64], len(right)), np.tile(right, len(left[at:at + 64]))
                if right is left:
                    a, b = a[a < b], b[a < b]
                found.append(passing(rows, maps, a, b))
        a, b, score = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
        busy = np.unique(rows["list"][a])
        if forest:
            pick = _spanning(a, b, score, rows["comp"])
            a, b = a[pick], b[pick]
        x, y = rows["grp"][a], rows["grp"][b]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)
        pairs, marks = len(both), len(busy) if forest else 0
        none = np.arange(pairs + marks) >= pairs
        ids = [np.concatenate([both[:, k], np.zeros(marks, np.int64)]) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(ids[0], mask=none), pa.array(ids[1], mask=none),
                                           pa.array(np.concatenate([np.zeros(pairs, np.int64), busy[:marks]]), mask=~none)],
                                          names=["a", "b", "list"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "p", "q", "part", "grp", "n", "comp")}
            rows["mixed"], rows["exact"] = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("mixed", "exact"))
            rows["bits"] = np.array(batch.column("bits").to_pylist(), object)
            held.append(rows)
            whole = {k: np.concatenate([h[k] for h in held]) for k in rows}
            cut = np.flatnonzero(_changes(whole))[-1:]  # the last block pair may go on in the next batch
            if len(cut) and cut[0]:
                yield pairs_of({k: v[:cut[0]] for k, v in whole.items()})
            held = [{k: v[cut[0]:] for k, v in whole.items()}] if len(cut) else []
        if held:
            yield pairs_of(held[0])
    return run


def _changes(rows: dict) -> np.ndarray:
    change = np.ones(len(rows["list"]), bool)
    change[1:] = False
    for c in ("list", "p", "q"):
        change[1:] |= rows[c][1:] != rows[c][:-1]
    return change


def _verify(size: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        cache: dict[int, np.ndarray] = {}

        def the_set(key: int, packed) -> np.ndarray:
            if key not in cache:
                if len(cache) >= 256:
                    cache.clear()
                raw = unpack.decompress(packed.as_py())
                cache[key] = shingle_sets(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), size)[0]
            return cache[key]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            pa_, pb_ = batch.column("packed_a"), batch.column("packed_b")
            keep = []
            for i, (x, y) in enumerate(zip(a, b)):
                s, t = the_set(x, pa_[i]), the_set(y, pb_[i])
                common = len(np.intersect1d(s, t, assume_unique=True))
                if den * common >= num * (len(s) + len(t) - common):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()),
                                              pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])
    return run


def _rows_of(signed: DataFrame, ids: DataFrame, at_most: int, column: str) -> DataFrame:
    """``row`` and one wide column of ``signed`` for the rows in ``ids``: the ids are
    broadcast up to a checked number, else shuffled."""
    ids = ids.distinct()
    return signed.select("row", column).join(small_enough(ids, at_most if at_most <= BROADCAST_IDS else None), "row", "left_semi")


def _links(pairs: DataFrame, signed: DataFrame, size: int, num: int, den: int, name: str) -> DataFrame:
    """The pairs that are links, by exact overlap of their whole texts."""
    pairs = saved(pairs, f"{name}-pairs", narrow=True)
    texts = _rows_of(signed, pairs.select(F.explode(F.array("a", "b")).alias("row")), 2 * pairs.count(), "packed")
    full = (pairs.join(texts.withColumnsRenamed({"row": "b", "packed": "packed_b"}).hint("merge"), "b")
            .join(texts.withColumnsRenamed({"row": "a", "packed": "packed_a"}).hint("merge"), "a"))
    full = full.select("a", "b", "packed_a", "packed_b")
    return saved(full.mapInArrow(_verify(size, num, den), "a long, b long"), f"{name}-links")


def near_duplicate_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                              num: int = 80, den: int = 100, row_col: str | None = None) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept, row_id`` for every row of ``docs``.

    ``size`` words a shingle; documents link at a Jaccard similarity of
    ``num / den``.  ``kept`` marks one row of each component, that of its least
    id (rows without shingles are all kept).
    """
    spark = docs.sparkSession
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    source = id_and_bytes(docs, id_col, text_col, row.cast("long").alias("row"))

    often = source.mapInArrow(_count_often(size), "shingle long, found long").groupBy("shingle").agg(F.sum("found").alias("found"))
    top = often.orderBy(F.desc("found"), "shingle").limit(HEAVY).select("shingle").toArrow()  # at most HEAVY values of 8 bytes
    key = top.column("shingle").to_numpy().view(np.uint64)
    order = np.argsort(key)
    rank = np.arange(len(key), 0, -1).astype(np.uint64)  # the most frequent shingle is the very last
    shared = spark.sparkContext.broadcast((key[order], rank[order]))

    signed = saved(source.mapInArrow(_sign(shared, size, num, den), _SIGNED), "join-signed")
    filled = signed.where("n > 0")
    first = F.struct(F.col("id").isNull(), "id", "row")
    leaders = filled.groupBy("n", "d1", "d2").agg(F.min(first)["row"].alias("cls"))
    member = saved(filled.select("row", "id", "n", "d1", "d2", "p1", "p2").join(leaders, ["n", "d1", "d2"])
                   .select("row", "id", "cls", "n", "p1", "p2"), "join-classes", narrow=True)
    classes = member.where("row = cls").select("cls", "n", "p1", "p2")
    groups = classes.groupBy("n", "p1", "p2").agg(F.min("cls").alias("grp"), F.count(F.lit(1)).alias("c")).where("c > 1")
    more = saved(classes.join(groups, ["n", "p1", "p2"]).where("cls != grp").select("grp", "cls", "n"), "join-groups", narrow=True)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    posted = (signed.select("row", "n", "light", "prefix").join(classes.select(F.col("cls").alias("row")).hint("merge"), "row", "left_semi")
              .join(small_enough(more.select(F.col("cls").alias("row"))), "row", "left_anti")
              .select(F.col("row").alias("cls"), "n", "light", "prefix")
              .mapInArrow(_post(BUCKETS_PER_PARTITION * partitions), "bucket int, data binary"))
    starred = saved(posted.repartition(partitions, "bucket").sortWithinPartitions("bucket")
                    .mapInArrow(_star(num, den), "grp long, other long, tok long, n long, pos long"), "join-stars")
    least_prefix = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    pairs = (starred.where("other IS NOT NULL").groupBy(F.col("grp").alias("a"), F.col("other").alias("b"))
             .agg(F.sum("tok").alias("lists"), F.max(least_prefix).alias("prefix")).where(F.col("lists") * EVIDENCE >= F.col("prefix"))
             .select("a", "b").transform(lambda p: _expand(p, more))
             .unionByName(more.select(F.col("grp").alias("a"), F.col("cls").alias("b"))).distinct())
    links = _links(pairs, signed, size, num, den, "join-star")
    comp = components(links)
    # lists that still hold more than one component: first the best pairs between
    # components, then, between those still apart, every pair
    lists = starred.where("other IS NULL").select("tok", "grp", "n", "pos")
    for step, forest in (("best", True), ("rest", False)):
        pairs, busy = _open_pairs(lists, more, comp, signed, num, den, forest, f"join-{step}")
        # components only grow, so a list without a candidate now has none later
        lists = lists.join(small_enough(busy), "tok", "left_semi")
        links = links.unionByName(_links(pairs, signed, size, num, den, f"join-{step}"))
        comp = components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(links))

    labelled = (member.select("row", "id", "n", "cls")
                .join(small_enough(comp.select(F.col("node").alias("cls"), "component")), "cls", "left")
                .select("row", "id", "n", F.coalesce("component", "cls").alias("comp")))
    least = labelled.groupBy("comp").agg(F.min(first).alias("least"))
    out = labelled.join(least, "comp").select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("least.id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("kept"), F.col("row").alias("row_id"))
    alone = signed.where("n = 0").select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("n_shingles"),
                                         F.col("id").alias("component_id"), F.lit(True).alias("kept"), F.col("row").alias("row_id"))
    return out.unionByName(alone)


def _open_pairs(lists: DataFrame, more: DataFrame, comp: DataFrame, signed: DataFrame, num: int, den: int, forest: bool,
                name: str) -> tuple[DataFrame, DataFrame]:
    """Class pairs between components, from the lists that hold more than one, and
    (with ``forest``) the lists that have any candidate.

    A group whose classes lie in several components is ``mixed``; the bitmap of a
    group is that of its first class and bounds nothing for groups of several
    (not ``exact``).
    """
    nodes = comp.count()
    comp_of = lambda c: small_enough(comp.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), nodes)
    inner = (more.join(comp_of("cls"), "cls", "left").join(comp_of("grp"), "grp", "left")
             .select("grp", "cls", "n", F.coalesce("c_cls", "cls").alias("c_cls"), F.coalesce("c_grp", "grp").alias("c_grp")))
    mixed = inner.groupBy("grp").agg(F.max(F.col("c_cls") != F.col("c_grp")).alias("mixed"))
    listed = (lists.join(comp_of("grp"), "grp", "left").join(small_enough(mixed, more.count()), "grp", "left")
              .select("tok", "grp", "n", "pos", F.coalesce("c_grp", "grp").alias("comp"), F.coalesce("mixed", F.lit(False)).alias("mixed"),
                      F.col("mixed").isNull().alias("exact")))
    open_lists = saved(listed.groupBy("tok").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi"),
                                                 F.max("mixed").alias("m"))
                       .where("size > 1 AND (lo != hi OR m)").select("tok", "size"), f"{name}-open", narrow=True)
    n_open = open_lists.count()
    held = listed.join(small_enough(open_lists, n_open), "tok").select("tok", "grp", "n", "pos", "comp", "mixed", "exact", "size")
    few = held.where(F.col("size") <= SMALL).drop("size").repartition("tok").sortWithinPartitions("tok")
    few = few.mapInArrow(_with_partners(num, den), few.schema)
    held = saved(few.unionByName(held.where(F.col("size") > SMALL).drop("size")).drop("pos"), f"{name}-held")
    # lists of the same groups give the same pairs: one of them is enough
    alike = (held.groupBy("tok").agg(F.count(F.lit(1)).alias("size"), F.sum(F.xxhash64("grp").cast("decimal(20,0)")).alias("s1"),
                                     F.bit_xor(F.xxhash64("grp", F.lit(1))).alias("s2"))
             .groupBy("size", "s1", "s2").agg(F.min("tok").alias("tok")).select("tok", "size"))
    wanted = saved(held.join(small_enough(alike, n_open), "tok").withColumnRenamed("tok", "list"), f"{name}-wanted", narrow=True)
    across = saved(_all_pairs(wanted, signed, num, den, forest), f"{name}-across", narrow=True)
    pairs = _expand(across.where("a IS NOT NULL").select("a", "b"), more)
    if not mixed.where("mixed").isEmpty():
        within = inner.join(mixed.where("mixed").select("grp"), "grp")
        within = (within.select(F.col("grp").alias("list"), F.col("cls").alias("grp"), "n", F.col("c_cls").alias("comp"))
                  .unionByName(within.select(F.col("grp").alias("list"), "grp", "n", F.col("c_grp").alias("comp")).distinct()))
        sizes = within.groupBy("list").agg(F.count(F.lit(1)).alias("size"))
        within = saved(within.join(sizes, "list").select("list", "grp", "n", "comp", "size", F.lit(False).alias("mixed"),
                                                         F.lit(True).alias("exact")), f"{name}-within", narrow=True)
        pairs = pairs.unionByName(_all_pairs(within, signed, num, den, forest).where("a IS NOT NULL").select("a", "b")).distinct()
    pairs = (pairs.join(comp_of("a"), "a", "left").join(comp_of("b"), "b", "left")
             .where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b"))
    return pairs, across.where("list IS NOT NULL").select(F.col("list").alias("tok")).distinct()


def _expand(pairs: DataFrame, more: DataFrame) -> DataFrame:
    """Group pairs to pairs of their classes (a group is named by its first class)."""
    for side in ("a", "b"):
        wider = pairs.join(more.select(F.col("grp").alias(side), F.col("cls").alias("_cls")), side, "left")
        both = F.explode(F.array_distinct(F.array(F.col(side), F.coalesce("_cls", side)))).alias(side)
        pairs = wider.select(*[both if c == side else F.col(c) for c in pairs.columns])
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _all_pairs(listed: DataFrame, signed: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """Filtered pairs of every list, in pairs of blocks of about ``BLOCK`` groups.

    ``listed``: list, grp, n, comp, size, mixed, exact; a written table.
    """
    bits = _rows_of(signed, listed.select(F.col("grp").alias("row")), listed.count(), "bits")
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("long")
    rows = (listed.join(bits.withColumnRenamed("row", "grp").hint("merge"), "grp")
            .withColumn("part", F.pmod(F.xxhash64("grp"), parts))
            .withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
            .select("list", F.least("part", "with").alias("p"), F.greatest("part", "with").alias("q"), "part", "grp",
                    F.col("n").cast("long").alias("n"), "comp", "mixed", "exact", "bits"))
    return (rows.repartition("list", "p", "q").sortWithinPartitions("list", "p", "q")
            .mapInArrow(_block_pairs(num, den, forest), "a long, b long, list long").distinct())


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80,
                     den: int = 100) -> DataFrame:
    """``docs`` with one row of each component, all columns as they were.

    Rows are told apart by their place in files (see :func:`common.numbered`).
    """
    row = unused(docs, "_join_row")
    rows = numbered(docs, row)
    gone = (near_duplicate_components(rows, id_col, text_col, size, num, den, row).where("NOT kept")
            .select(F.col("row_id").alias(row)))
    return without_rows(rows, row, gone, docs.columns, "join-dropped")
