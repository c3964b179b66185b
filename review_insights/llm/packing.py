"""Sum-of-squares online packing of token documents into fixed windows.

Each task packs the documents of its partition in one pass.  The state is a
level array: ``count[h]`` is the number of windows filled up to ``h``.  A piece
of ``s`` tokens goes to the level ``h`` (0 opens a window) that makes the sum
of squared counts of partially filled windows smallest; among equal choices
the fullest window wins.  Of a document of a window or more, whole windows
are cut off first and the remainder is placed.

When the partition ends, the windows left open are closed without padding:
content of the emptiest windows is cut into the gaps of the fullest until one
partial window is left, and this one is cut into windows of power-of-two
lengths, which need no padding.  So at most ``log2(capacity)`` short sequences
come from a partition, and only pieces of the last open windows are cut.

A document's tokens are its byte-level BPE ids followed by one end id.  The
ids are those of the ``tokenizers`` file; they are computed with ``tiktoken``
over the same vocabulary as ranks, which gives equal ids several times faster
(tested); texts beyond ``LONG_TEXT`` characters go through ``tokenizers``.

Scale: no shuffle and no global state; a task holds one batch of texts and at
most ``MAX_OPEN`` open windows with their ids.  Lengths that fit no other (all just
over half a window, say) fill that bound; the windows are then closed as at the end
of a partition, which cuts nearly every second document of them but pads none.  ``sequence_id`` is made of the
partition number and a counter, so a task run again gives the same ids.

Defined results: a null or empty text is the end id alone; repeated rows are
packed each; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import partition_id

CAPACITY = 2048
END_ID = 1
END_OF_TEXT = "<|endoftext|>"
END_OF_TEXT_ID = 50256
LONG_TEXT = 1_000_000
#: Windows a task keeps open; beyond, they are closed by cutting, as at the end.
MAX_OPEN = 8_192
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


class Encoder:
    """Token ids of whole texts for one byte-level vocabulary."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import base64

        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self._fast = tiktoken.Encoding("corpus", pat_str=pattern, mergeable_ranks=ranks,
                                       special_tokens={END_OF_TEXT: END_OF_TEXT_ID})
        self._json_path = json_path
        self._exact = None

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= LONG_TEXT:
            return self._fast.encode_to_numpy(text, allowed_special="all").astype("<u4")
        if self._exact is None:
            from tokenizers import Tokenizer

            self._exact = Tokenizer.from_file(self._json_path)
        return np.array(self._exact.encode(text, add_special_tokens=False).ids, "<u4")


def default_paths() -> tuple[str, str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN


class SumOfSquaresPacker:
    """Online packing with a level array.  ``place`` and ``close`` return closed
    windows, each a list of pieces ``(document, start, length)``."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.open: dict[int, list[list[tuple]]] = {}

    def level_for(self, size: int) -> int:
        levels = np.arange(self.capacity - size + 1)
        here, there = self.count[:self.capacity - size + 1], self.count[size:]
        change = 2 * there + 1 - 2 * here + 1  # (n_there + 1)^2 - n_there^2 + (n_here - 1)^2 - n_here^2
        change[0] = 2 * there[0] + 1           # a new window leaves no level
        change[-1] -= 2 * there[-1] + 1        # a full window is counted nowhere
        usable = here > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(levels[::-1][np.argmin(change[::-1])])

    @property
    def open_windows(self) -> int:
        return int(self.count.sum())

    def place(self, doc, start: int, length: int) -> list[list[tuple]]:
        closed = []
        while length >= self.capacity:
            closed.append([(doc, start, self.capacity)])
            start, length = start + self.capacity, length - self.capacity
        if length == 0:
            return closed
        level = self.level_for(length)
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
        else:
            window = []
        window.append((doc, start, length))
        level += length
        if level == self.capacity:
            closed.append(window)
        else:
            self.open.setdefault(level, []).append(window)
            self.count[level] += 1
        return closed

    def close(self) -> list[list[tuple]]:
        """Empty the level array without padding."""
        left = deque(sorted(((level, w) for level, ws in self.open.items() for w in ws), key=lambda x: -x[0]))
        self.open, self.count = {}, np.zeros(self.capacity + 1, np.int64)
        closed: list[list[tuple]] = []
        while left:
            level, window = left.popleft()
            while level < self.capacity and left:
                low_level, low = left.pop()
                doc, start, length = low.pop()
                take = min(length, self.capacity - level)
                window.append((doc, start, take))
                level += take
                if take < length:
                    low.append((doc, start + take, length - take))
                if low:
                    left.append((low_level - take, low))
            if level == self.capacity:
                closed.append(window)
            else:
                closed.extend(power_of_two_windows(window, level))
        return closed


def power_of_two_windows(window: list[tuple], fill: int) -> list[list[tuple]]:
    """Cut the pieces of one window into windows as long as the binary digits of ``fill``."""
    out, pieces = [], list(reversed(window))
    for bit in range(fill.bit_length() - 1, -1, -1):
        need = fill & (1 << bit)
        part = []
        while need:
            doc, start, length = pieces.pop()
            take = min(length, need)
            part.append((doc, start, take))
            need -= take
            if take < length:
                pieces.append((doc, start + take, length - take))
        if part:
            out.append(part)
    return out


def _pack(paths: tuple[str, str, str] | None, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*(paths or default_paths()))
        packer, sequence = SumOfSquaresPacker(capacity), partition_id() << 33
        schema = pa.schema([(f, pa.int64()) for f in FIELDS])

        def rows(windows: list[list[tuple]]) -> pa.RecordBatch:
            nonlocal sequence
            out: list[tuple] = []
            for window in windows:
                offset = 0
                for (doc_id, ids), start, length in window:
                    out.append((doc_id, start, length, zlib.crc32(ids[start:start + length].tobytes()),
                                len(ids), sequence, offset))
                    offset += length
                sequence += 1
            columns = list(zip(*out)) if out else [()] * len(FIELDS)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)

        for batch in batches:
            closed = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encoder.ids(text or ""), np.array([end_id], "<u4"))
                closed += packer.place((doc_id, ids), 0, len(ids))
                if packer.open_windows > MAX_OPEN:
                    closed += packer.close()
            yield rows(closed)
        yield rows(packer.close())
    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID, paths: tuple[str, str, str] | None = None) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    ``paths``: the vocabulary as a tokenizers file, as ranks, and its split
    pattern; by default those of the public byte-level vocabulary.
    """
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_pack(paths, capacity, end_id), ", ".join(f"{f} long" for f in FIELDS))
