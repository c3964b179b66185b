"""Removal of repeated byte strings by longest previous factors inside anchor groups.

A byte goes when it is covered by a string of ``SPAN`` bytes that also starts
earlier in the corpus (a smaller doc_id, or earlier in its document).  A
position has such an earlier match exactly when its longest previous factor is
``SPAN`` or more.  The factor is the longer of the common prefixes with the
previous and with the next smaller position in suffix order.

The suffix order is only needed among suffixes that can match, and these meet
without sorting the corpus:

1. Anchors.  Every window of ``SPAN`` bytes has an anchor, the ``ANCHOR``-byte
   string in it with the least hash; equal windows have equal anchors at equal
   places.  Neighbouring windows with one anchor form a stretch.
2. Stretches are shuffled by anchor as (anchor, hash of the whole stretch,
   length, place).  Of equal stretches all but the earliest are repeated in
   full.  An anchor with one kind of stretch is settled.
3. Only the earliest stretches of anchors with several kinds are read again as
   bytes.  The suffixes at their windows are sorted (cut at ``SPAN`` bytes), and
   the arrays of previous and next smaller positions give each its longest
   previous factor; from ``SPAN`` bytes the window is repeated.
4. Repeated windows go back to their documents; covered bytes are cut out.

Scale.  Text moves as compressed units of about ``UNIT_BYTES``.  Equal
stretches of a unit are collapsed before the first shuffle, so a copied passage
adds one row a unit however often it occurs.  Anchors found more than
``HOT_AT`` times (a common line in ever new surroundings) are counted over all
documents first; the windows of at most ``MAX_HOT`` of the most frequent ones
take another way: they are aggregated one by one by a 128-bit hash.  Stretch
equality rests on more than 96 bits of hashes; all other windows whose 64-bit
hash occurs twice are sorted by their bytes.

Defined results: a null text is empty; matches never cross documents; a text
shorter than ``SPAN`` keeps all bytes.  Of rows with one doc_id the one read
first counts as earlier.  A null id sorts after all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import SpanHash, blocks, id_and_bytes, packed, partition_id, saved, unpacked

SPAN = 100
ANCHOR = 32
UNIT_BYTES = 8_000_000
UNIT_DOCS = 60_000
TILE = 1 << 22
HOT_AT = 100_000
MAX_HOT = 1 << 16
LOCAL_HOT = 1       # an anchor counts in units that hold it so often: 1 is an exact count
BUCKETS_PER_PARTITION = 4
SORT_AT = 50_000        # suffixes sorted together

_LAST = np.iinfo(np.int64).max      # stands for a null id in the order
_PLACE = np.uint64((1 << 28) - 1)
_TEXT, _STRETCHES, _REPEATED, _OPEN = 0, 1, 2, 3
_ROWS = "bucket int, unit long, kind int, data binary"
_UNIT = "unit long, kind int, data binary"
_STRETCH = np.dtype([("anchor", "<u4"), ("hash", "<u8"), ("count", "u1"), ("id", "<i8"), ("doc", "<u2"), ("start", "<u4")])
_RANGE = np.dtype([("doc", "<u2"), ("start", "<u4"), ("count", "u1")])
_MARK = np.dtype([("doc", "<u2"), ("start", "<u4"), ("count", "u1"), ("group", "<u8")])
_PIECE = np.dtype([("id", "<i8"), ("unit", "<i8"), ("doc", "<u2"), ("start", "<u4"), ("count", "u1")])


def least_in_window(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by running minima inside blocks."""
    n = len(key)
    if n < width:
        return key[:0]
    full = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def _tiles(offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces to work on: byte range, offsets inside it, documents, and where in
    its document each piece begins."""
    for lo, hi in blocks(offsets):
        size = int(offsets[hi] - offsets[lo])
        if hi - lo == 1 and size > TILE + SPAN:
            for at in range(0, size - SPAN + 1, TILE):
                end = min(size, at + TILE + SPAN - 1)
                yield (int(offsets[lo]) + at, int(offsets[lo]) + end, np.array([0, end - at]), np.array([lo]), np.array([at]))
        else:
            yield (int(offsets[lo]), int(offsets[hi]), offsets[lo:hi + 1] - offsets[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64))


def stretches(data: np.ndarray, offsets: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """Stretches of all documents: doc, start, count (windows), anchor and hash,
    with the tile's ``spans`` (hashes of its byte spans) and ``at`` (starts in the tile)."""
    for lo, hi, inner, docs, base in _tiles(offsets):
        piece = data[lo:hi]
        n = len(piece)
        if n < SPAN:
            continue
        spans = SpanHash(piece)
        start = np.arange(n - ANCHOR + 1)
        h = spans.of(start, start + ANCHOR)
        least = least_in_window((h & ~_PLACE) | start.astype(np.uint64), SPAN - ANCHOR + 1)
        place = (least & _PLACE).astype(np.int64)
        first = np.arange(len(place))
        doc = np.searchsorted(inner, first, side="right") - 1
        inside = first + SPAN <= inner[doc + 1]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        at = np.flatnonzero(new & inside)
        if len(at) == 0:
            continue
        stop = np.flatnonzero(np.append((new | ~inside)[1:], True) & inside) + 1
        yield {"doc": docs[doc[at]], "start": at - inner[doc[at]] + base[doc[at]], "count": stop - at,
               "anchor": h[place[at]], "hash": SpanHash(piece, seed=1).of(at, stop + SPAN - 1),
               "at": at, "spans": (spans, piece)}


class Unit:
    """Documents of one task worked on together."""

    def __init__(self, number: int):
        self.number, self.ids, self.texts, self.size = number, [], [], 0

    def full(self) -> bool:
        return self.size >= UNIT_BYTES or len(self.ids) >= UNIT_DOCS

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        offsets = np.cumsum([0] + [len(t) for t in self.texts]).astype(np.int64)
        ids = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        return np.frombuffer(b"".join(self.texts), np.uint8), offsets, ids


def units(batches: Iterator[pa.RecordBatch]) -> Iterator[Unit]:
    unit = Unit(partition_id() << 31)
    for batch in batches:
        for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist()):
            unit.ids.append(doc_id)
            unit.texts.append(text)
            unit.size += len(text)
            if unit.full():
                yield unit
                unit = Unit(unit.number + 1)
    if unit.ids:
        yield unit


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = {"bucket": pa.int32(), "unit": pa.int64(), "kind": pa.int32(), "data": pa.binary(),
             "anchor": pa.int64(), "found": pa.int64()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[n]) for c, n in zip(columns, names)], names=names)


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for unit in units(batches):
        data, offsets, _ = unit.joined()
        found = [s["anchor"] for s in stretches(data, offsets)]
        anchor, count = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        often = count >= LOCAL_HOT
        yield pa.RecordBatch.from_arrays([pa.array(anchor[often].view(np.int64)), pa.array(count[often])], names=["anchor", "found"])


def _is_hot(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if len(hot) == 0:
        return np.zeros(len(anchor), bool)
    return hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor


def _send_stretches(shared, buckets: int):
    """Stretches of every unit by anchor bucket, equal ones collapsed to the earliest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for unit in units(batches):
            data, offsets, ids = unit.joined()
            parts = []
            for s in stretches(data, offsets):
                cold = ~_is_hot(s["anchor"], hot)
                parts.append({k: s[k][cold] for k in ("doc", "start", "count", "anchor", "hash")})
            unit.texts = []
            if not parts:
                continue
            doc, start, count, anchor, mark = (np.concatenate([p[k] for p in parts]) for k in ("doc", "start", "count", "anchor", "hash"))
            order = np.lexsort((start, doc, ids[doc], count, mark, anchor))
            same = np.zeros(len(order), bool)
            a, b = order[1:], order[:-1]
            same[1:] = (anchor[a] == anchor[b]) & (mark[a] == mark[b]) & (count[a] == count[b])
            repeated = np.sort(order[same])
            rows = []
            if len(repeated):
                table = np.empty(len(repeated), _RANGE)
                table["doc"], table["start"], table["count"] = doc[repeated], start[repeated], count[repeated]
                rows.append((int(unit.number % buckets), unit.number, _REPEATED, packed(table)))
            lead = np.sort(order[~same])
            bucket = (anchor[lead] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            lead, bucket = lead[by], bucket[by]
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            for k in range(buckets):
                pick = lead[edges[k]:edges[k + 1]]
                if len(pick):
                    table = np.empty(len(pick), _STRETCH)
                    table["anchor"], table["hash"], table["count"] = anchor[pick] >> np.uint64(32), mark[pick], count[pick]
                    table["id"], table["doc"], table["start"] = ids[doc[pick]], doc[pick], start[pick]
                    rows.append((k, unit.number, _STRETCHES, packed(table)))
            yield _batch(rows, ["bucket", "unit", "kind", "data"])
    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], dtype: np.dtype, keep) -> Iterator[tuple[int, list[int], list]]:
    """Rows come sorted by bucket: ``(bucket, units, payloads)``, one bucket at a time."""
    current, numbers, held = None, [], []
    for batch in batches:
        for i in range(batch.num_rows):
            bucket, unit, kind = (batch.column(c)[i].as_py() for c in ("bucket", "unit", "kind"))
            data = batch.column("data")[i].as_py()
            if kind == _REPEATED:
                keep.append((unit, _REPEATED, data))
                continue
            if bucket != current and held:
                yield current, numbers, held
                numbers, held = [], []
            current = bucket
            numbers.append(unit)
            held.append(data)
    if held:
        yield current, numbers, held


def _match_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per unit: stretches that are repeated, and stretches left open (same anchor,
    different surroundings), the earliest of each kind."""
    keep: list[tuple] = []
    for bucket, numbers, held in _by_bucket(batches, _STRETCH, keep):
        tables = [unpacked(h, _STRETCH) for h in held]
        t = np.concatenate(tables)
        unit = np.repeat(np.array(numbers, np.int64), [len(x) for x in tables])
        order = np.lexsort((t["start"], t["doc"], unit, t["id"], t["count"], t["hash"], t["anchor"]))
        t, unit = t[order], unit[order]
        n = len(t)
        group = np.ones(n, bool)
        group[1:] = t["anchor"][1:] != t["anchor"][:-1]
        kind = group.copy()
        kind[1:] |= (t["hash"][1:] != t["hash"][:-1]) | (t["count"][1:] != t["count"][:-1])
        number = np.cumsum(group) - 1
        several = np.bincount(number, kind)[number] >= 2
        rows = list(keep)
        keep.clear()
        for flag, code in ((~kind, _REPEATED), (kind & several, _OPEN)):
            pick = np.flatnonzero(flag)
            pick = pick[np.lexsort((t["start"][pick], t["doc"][pick], unit[pick]))]
            cut = np.flatnonzero(np.diff(unit[pick], prepend=-1, append=-1)) if len(pick) else []
            for a, b in zip(cut[:-1], cut[1:]):
                part = pick[a:b]
                table = np.empty(len(part), _RANGE if code == _REPEATED else _MARK)
                for f in ("doc", "start", "count"):
                    table[f] = t[f][part]
                if code == _OPEN:
                    table["group"] = (t["anchor"][part].astype(np.uint64) << np.uint64(20)) ^ np.uint64(bucket)
                rows.append((int(unit[part[0]]), code, packed(table)))
        yield _batch(rows, ["unit", "kind", "data"])
    if keep:
        yield _batch(keep, ["unit", "kind", "data"])


def _send_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    for unit in units(batches):
        data, offsets, ids = unit.joined()
        null = np.array([i is None for i in unit.ids], np.uint8)
        body = len(ids).to_bytes(8, "little") + ids.tobytes() + np.diff(offsets).tobytes() + null.tobytes()
        yield _batch([(unit.number, _TEXT, press.compress(body + data.tobytes()))], ["unit", "kind", "data"])


def _with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]]:
    """Rows come sorted by (unit, kind): ``(unit, data, offsets, ids, null, rest)``."""
    import zstandard

    unpack, current, text, rest = zstandard.ZstdDecompressor(), None, None, []

    def whole():
        raw = unpack.decompress(text)
        n = int.from_bytes(raw[:8], "little")
        ids = np.frombuffer(raw, np.int64, n, 8)
        sizes = np.frombuffer(raw, np.int64, n, 8 + 8 * n)
        null = np.frombuffer(raw, np.uint8, n, 8 + 16 * n).astype(bool)
        return current, np.frombuffer(raw, np.uint8, offset=8 + 17 * n), np.concatenate([[0], np.cumsum(sizes)]), ids, null, rest

    for batch in batches:
        for i in range(batch.num_rows):
            unit, kind = batch.column("unit")[i].as_py(), batch.column("kind")[i].as_py()
            if kind == _TEXT:
                if current is not None:
                    yield whole()
                current, text, rest = unit, batch.column("data")[i].as_py(), []
            else:
                rest.append((kind, batch.column("data")[i].as_py()))
    if current is not None:
        yield whole()


def _send_open(buckets: int):
    """The bytes of open stretches, by anchor."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for unit, data, offsets, ids, _, rest in _with_text(batches):
            if not rest:
                continue
            t = np.concatenate([unpacked(d, _MARK) for _, d in rest])
            t = t[np.lexsort((t["start"], t["doc"]))]
            bucket = (t["group"] % np.uint64(buckets)).astype(np.int64)
            rows = []
            by = np.argsort(bucket, kind="stable")
            edges = np.searchsorted(bucket[by], np.arange(buckets + 1))
            for k in range(buckets):
                part = t[by[edges[k]:edges[k + 1]]]
                if len(part) == 0:
                    continue
                table = np.empty(len(part), _PIECE)
                table["id"], table["unit"] = ids[part["doc"]], unit
                for f in ("doc", "start", "count"):
                    table[f] = part[f]
                lo = offsets[part["doc"]] + part["start"]
                text = b"".join(data[a:a + c + SPAN - 1].tobytes() for a, c in zip(lo.tolist(), part["count"].tolist()))
                head = packed(table)
                rows.append((k, unit, _OPEN, len(head).to_bytes(4, "little") + head + press.compress(text)))
            yield _batch(rows, ["bucket", "unit", "kind", "data"])
    return run


def common_prefixes(columns: np.ndarray) -> np.ndarray:
    """Bytes that each row (big-endian words, sorted) has in common with the row before, ``SPAN`` at most; 0 for the first."""
    out = np.zeros(len(columns), np.int64)
    if len(columns) < 2:
        return out
    open_ = np.ones(len(columns) - 1, bool)
    for c in range(columns.shape[1]):
        word = columns[:, c].astype(np.uint64)
        differ = word[1:] ^ word[:-1]
        # leading bytes that agree: the others begin at the highest byte that differs
        agree = np.full(len(differ), 8)
        for k in range(8):
            agree[(differ >> np.uint64(56 - 8 * k)) != 0] = np.minimum(agree, k)[(differ >> np.uint64(56 - 8 * k)) != 0]
        out[1:][open_] += agree[open_]
        open_ &= differ == 0
    return np.minimum(out, SPAN)


def previous_smaller(position: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix the nearest one before it, in suffix order, with a smaller position (-1: none), and the
    common prefix with it.  ``common[k]`` is that of suffixes ``k - 1`` and ``k``.

    All pointers jump at once: a suffix that points to a larger position takes over where that one points to,
    since everything between is larger still.
    """
    before = np.arange(-1, len(position) - 1)
    shared = common.copy()
    while True:
        at = np.flatnonzero(before >= 0)
        at = at[position[before[at]] > position[at]]
        if len(at) == 0:
            break
        over = before[at]
        shared[at] = np.minimum(shared[at], shared[over])
        before[at] = before[over]
    shared[before < 0] = 0
    return before, shared


def longest_previous_factors(position: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Longest previous factor of every suffix, from the positions and the common prefixes of neighbours in suffix
    order: the longer of the common prefixes with the previous and the next smaller position."""
    n = len(position)
    _, up = previous_smaller(position, common)
    _, down = previous_smaller(position[::-1], np.append(common[1:], 0)[::-1] if n else common)
    return np.maximum(up, down[::-1])


def repeated_windows(text: np.ndarray, starts: np.ndarray, order_keys: tuple[np.ndarray, ...]) -> np.ndarray:
    """For the suffixes at ``starts``: whether their longest previous factor (``order_keys`` give the
    positions, most significant first) has ``SPAN`` bytes.

    Suffixes are sorted by their first ``SPAN`` bytes.  One whose hash occurs once has a shorter factor and is
    left out.
    """
    out = np.zeros(len(starts), bool)
    h = SpanHash(text).of(starts, starts + SPAN)
    by = np.argsort(h, kind="stable")
    same = h[by[1:]] == h[by[:-1]]
    some = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if len(some) == 0:
        return out
    # suffixes of one hash are sorted together, about SORT_AT at a time
    edge = np.flatnonzero(np.concatenate([[True], h[some[1:]] != h[some[:-1]]]))
    edge = np.append(edge[np.concatenate([[True], np.diff(edge // SORT_AT) > 0])], len(some))
    for lo, hi in zip(edge[:-1], edge[1:]):
        part = some[lo:hi]
        padded = np.zeros((len(part), -(-SPAN // 8) * 8), np.uint8)
        for at in range(0, len(part), SORT_AT):
            padded[at:at + SORT_AT, :SPAN] = text[starts[part[at:at + SORT_AT], None] + np.arange(SPAN)]
        columns = padded.view(">u8")
        order = np.lexsort(tuple(k[part] for k in reversed(order_keys)) + tuple(columns[:, c] for c in range(columns.shape[1] - 1, -1, -1)))
        position = np.empty(len(part), np.int64)
        position[np.lexsort(tuple(k[part] for k in reversed(order_keys)))] = np.arange(len(part))
        factors = longest_previous_factors(position[order], common_prefixes(columns[order]))
        out[part[order[factors >= SPAN]]] = True
    return out


def _match_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpack = zstandard.ZstdDecompressor()
    for _, numbers, held in _by_bucket(batches, _PIECE, []):
        tables, texts = [], []
        for h in held:
            n = int.from_bytes(h[:4], "little")
            tables.append(unpacked(h[4:4 + n], _PIECE))
            texts.append(unpack.decompress(h[4 + n:]))
        t = np.concatenate(tables)
        text = np.frombuffer(b"".join(texts), np.uint8)
        count = t["count"].astype(np.int64)
        begin = np.concatenate([[0], np.cumsum(count + SPAN - 1)])[:-1]
        owner = np.repeat(np.arange(len(t)), count)
        step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        start = t["start"][owner].astype(np.int64) + step
        again = repeated_windows(text, begin[owner] + step, (t["id"][owner], t["unit"][owner], t["doc"][owner], start))
        pick = np.flatnonzero(again)
        rows = []
        if len(pick):
            unit, doc, at = t["unit"][owner[pick]], t["doc"][owner[pick]], start[pick]
            rows = _ranges(unit, doc, at)
        yield _batch(rows, ["unit", "kind", "data"])


def _ranges(unit: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[tuple]:
    """Repeated window starts as packed ranges, one row a unit."""
    order = np.lexsort((at, doc, unit))
    unit, doc, at = unit[order], doc[order].astype(np.int64), at[order]
    new = np.ones(len(at), bool)
    new[1:] = (unit[1:] != unit[:-1]) | (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    run = np.flatnonzero(new)
    place = np.arange(len(at)) - run[np.cumsum(new) - 1]
    new |= place % 200 == 0  # the count of a range fits one byte
    run = np.flatnonzero(new)
    size = np.diff(np.append(run, len(at)))
    rows = []
    cut = np.flatnonzero(np.diff(unit[run], prepend=-1, append=-1))
    for a, b in zip(cut[:-1], cut[1:]):
        table = np.empty(b - a, _RANGE)
        table["doc"], table["start"], table["count"] = doc[run[a:b]], at[run[a:b]], size[a:b]
        rows.append((int(unit[run[a]]), _REPEATED, packed(table)))
    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Covered bytes leave their documents."""
    for _, data, offsets, ids, null, rest in _with_text(batches):
        change = np.zeros(len(data) + 1, np.int32)
        for _, d in rest:
            t = unpacked(d, _RANGE)
            lo = offsets[t["doc"]] + t["start"]
            np.add.at(change, lo, 1)
            np.add.at(change, lo + t["count"] + SPAN - 1, -1)
        covered = np.cumsum(change[:-1], dtype=np.int32) > 0
        before = np.zeros(len(data), bool)
        before[1:] = covered[:-1]
        first = offsets[:-1][np.diff(offsets) > 0]
        before[first] = False
        n, filled = np.diff(offsets), np.diff(offsets) > 0
        gone, runs = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        if len(first):
            gone[filled] = np.add.reduceat(covered, first, dtype=np.int64)
            runs[filled] = np.add.reduceat(covered & ~before, first, dtype=np.int64)
        shas = []
        for i in range(len(ids)):
            a, b = offsets[i], offsets[i + 1]
            body = data[a:b] if gone[i] == 0 else data[a:b][~covered[a:b]]
            shas.append(hashlib.sha256(body.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, mask=null), pa.array(n), pa.array(gone.astype(np.int64)),
                                          pa.array(runs.astype(np.int64)), pa.array(shas, pa.string())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _send_hot(shared):
    """The windows of hot anchors: of equal ones in a unit the earliest has to be
    compared with other units, the rest (``sure``) are repeated."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = shared.value
        for unit in units(batches):
            data, offsets, ids = unit.joined()
            parts = []
            for s in stretches(data, offsets):
                pick = np.flatnonzero(_is_hot(s["anchor"], hot))
                if len(pick) == 0:
                    continue
                count = s["count"][pick]
                owner = np.repeat(pick, count)
                step = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                spans, piece = s["spans"]
                at = s["at"][owner] + step
                parts.append((spans.of(at, at + SPAN), SpanHash(piece, seed=2).of(at, at + SPAN),
                              s["doc"][owner].astype(np.int64), (s["start"][owner] + step).astype(np.int64)))
            if not parts:
                continue
            h1, h2, doc, start = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((start, doc, ids[doc], h2, h1))
            h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
            sure = np.zeros(len(h1), bool)
            sure[1:] = (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
            yield pa.RecordBatch.from_arrays([
                pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(ids[doc]),
                pa.array(np.full(len(doc), unit.number)), pa.array(doc), pa.array(start), pa.array(sure)],
                names=["h1", "h2", "id", "unit", "doc", "start", "sure"])
    return run


def _hot_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        unit, doc, at = (batch.column(c).to_numpy() for c in ("unit", "doc", "start"))
        yield _batch(_ranges(unit, doc, at) if len(unit) else [], ["unit", "kind", "data"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_at: int = HOT_AT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs``."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = BUCKETS_PER_PARTITION * partitions
    source = id_and_bytes(docs, id_col, text_col)

    counted = source.mapInArrow(_count_anchors, "anchor long, found long").groupBy("anchor").agg(F.sum("found").alias("found"))
    top = counted.where(F.col("found") >= hot_at).orderBy(F.desc("found"), "anchor").limit(MAX_HOT).select("anchor").collect()
    hot = np.sort(np.array([r["anchor"] for r in top], np.int64).view(np.uint64))  # at most MAX_HOT values of 8 bytes
    shared = spark.sparkContext.broadcast(hot)

    sent = source.mapInArrow(_send_stretches(shared, buckets), _ROWS)
    marks = saved(sent.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_match_stretches, _UNIT), "lpf-marks")
    text = source.mapInArrow(_send_text, _UNIT)
    opened = (text.unionByName(marks.where(F.col("kind") == _OPEN)).repartition(partitions, "unit").sortWithinPartitions("unit", "kind")
              .mapInArrow(_send_open(buckets), _ROWS))
    again = saved(opened.repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_match_windows, _UNIT), "lpf-windows")
    found = marks.where(F.col("kind") == _REPEATED).unionByName(again)
    if len(hot):
        windows = source.mapInArrow(_send_hot(shared), "h1 long, h2 long, id long, unit long, doc long, start long, sure boolean")
        windows = saved(windows, "lpf-hot")
        place = F.struct("id", "unit", "doc", "start")
        open_ = windows.where("NOT sure")
        first = open_.groupBy("h1", "h2").agg(F.min(place).alias("first"))
        later = open_.join(first, ["h1", "h2"]).where(place != F.col("first")).select("unit", "doc", "start")
        later = later.unionByName(windows.where("sure").select("unit", "doc", "start"))
        found = found.unionByName(later.sortWithinPartitions("unit", "doc", "start").mapInArrow(_hot_ranges, _UNIT))
    whole = text.unionByName(found).repartition(partitions, "unit").sortWithinPartitions("unit", "kind")
    return whole.mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
