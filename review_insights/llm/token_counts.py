"""Token counts: pieces are counted once per distinct pre-token and joined to the
pre-token frequencies of the documents; no token id is ever made.

1. Each task splits its texts into pre-tokens and sums, for a unit of about
   ``UNIT_CHARS`` characters, how often each document holds each distinct one.
   The unit's frequency table is cut by a hash of the pre-token into buckets,
   and every bucket leaves as one compressed block: the distinct pre-tokens,
   and for each the documents and counts.
2. The join: blocks are shuffled by bucket, so that every distinct pre-token
   meets the tokenizer in one task only.  It is counted there once, and each
   block becomes partial sums for the documents of its unit.
3. Partial sums are shuffled back by unit and added up.

A common word costs one entry a document in blocks that are spread by unit,
so no word makes a hot key; a task holds one unit, or one bucket's vocabulary.

The counts equal the length of the tokenizer's ids for the whole text without
added special tokens.  Its special strings inside a text count as one token
each, as by default.  Texts of printable ASCII, tab, line ends and Latin-1
letters are split here; any other text, also one with other control characters,
is normalised and split by the library itself.

Defined results: a null or empty text has 0 tokens; repeated rows are counted
each; a null id stays null; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import partition_id

LIMIT = 2048
UNIT_CHARS = 24_000_000
UNIT_DOCS = 60_000
BUCKETS_PER_PARTITION = 4

# FIXED VALUES: the special strings of the vocabulary and its contractions.
SPECIALS = ("<|startoftext|>", "<|endoftext|>")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ–—‘’“”…]*")
_SPECIAL = re.compile("|".join(map(re.escape, SPECIALS)))

_BLOCK = "bucket int, unit long, kind int, docs binary, words binary, counts binary"


class PreTokens:
    """Splits a text into the pre-tokens of the vocabulary, and counts pieces."""

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.normalizers import Sequence

        if path is None:
            import public_tokenizers as P

            path = P.path("word_bpe_49k.json")
        self._tokenizer = Tokenizer.from_file(path)
        # pre-tokens are normalised already; a second time would reorder marks that lower-casing has made
        self._normalised = Tokenizer.from_file(path)
        self._normalised.normalizer = Sequence([])

    def split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens, and how many special strings stand between them."""
        if "<|" not in text:
            return self._segment(text), 0
        parts = _SPECIAL.split(text)
        return [w for p in parts for w in self._segment(p)], len(parts) - 1

    def _segment(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _SPLIT.findall(text.lower())
        plain = self._tokenizer.normalizer.normalize_str(text)
        return [plain[a:b] for _, (a, b) in self._tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def pieces(self, words: list[str]) -> list[int]:
        return [len(e.ids) for e in self._normalised.encode_batch_fast(words, add_special_tokens=False)]


def _frequencies(path: str | None, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        splitter, press = PreTokens(path), zstandard.ZstdCompressor(level=3)
        unit = partition_id() << 31
        schema = pa.schema([("bucket", pa.int32()), ("unit", pa.int64()), ("kind", pa.int32()),
                            ("docs", pa.binary()), ("words", pa.binary()), ("counts", pa.binary())])

        def flush() -> pa.RecordBatch:
            nonlocal unit
            n_docs = len(ids)
            head = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                                               pa.array(specials, pa.int64())], names=["id", "bytes", "base"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as w:
                w.write_batch(head)
            rows = [(zlib.crc32(str(unit).encode()) % buckets, unit, 0, press.compress(sink.getvalue().to_pybytes()), None, None)]
            word, doc = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (found, owner))
            pair, count = np.unique(word.astype(np.int64) * n_docs + doc, return_counts=True)
            word, doc = pair // max(n_docs, 1), pair % max(n_docs, 1)
            names = list(number)
            bucket = np.array([zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in names], np.int64)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            by = np.argsort(place[word], kind="stable")
            word, doc, count = place[word][by], doc[by], count[by]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            starts = np.searchsorted(word, edges)
            for b in range(buckets):
                if edges[b] == edges[b + 1]:
                    continue
                cut = slice(starts[b], starts[b + 1])
                per_word = np.bincount(word[cut] - edges[b], minlength=edges[b + 1] - edges[b]).astype("<u4")
                rows.append((b, unit, 1, press.compress(per_word.tobytes() + doc[cut].astype("<u2").tobytes()),
                             press.compress("\n".join(names[i] for i in order[edges[b]:edges[b + 1]]).encode("utf-8")),
                             press.compress(np.ascontiguousarray(count[cut].astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())))
            unit += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

        def fresh():
            return [], [], [], [], [], defaultdict(itertools.count().__next__), 0

        ids, sizes, specials, found, owner, number, chars = fresh()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                words, base = splitter.split(text)
                if words:
                    found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                    owner.append(np.full(len(words), len(ids), np.int32))
                ids.append(doc_id)
                sizes.append(len(text.encode("utf-8")))
                specials.append(base)
                chars += len(text)
                if chars >= UNIT_CHARS or len(ids) >= UNIT_DOCS:
                    yield flush()
                    ids, sizes, specials, found, owner, number, chars = fresh()
        if ids:
            yield flush()
    return run


def _count_pieces(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        counter, unpack, press = PreTokens(path), zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=3)
        known: dict[str, int] = {}
        schema = pa.schema([("unit", pa.int64()), ("kind", pa.int32()), ("docs", pa.binary())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    out.append((row["unit"], 0, row["docs"]))
                    continue
                words = unpack.decompress(row["words"]).decode("utf-8").split("\n")
                new = [w for w in words if w not in known]
                if new:
                    known.update(zip(new, counter.pieces(new)))
                raw = unpack.decompress(row["docs"])
                per_word = np.frombuffer(raw, "<u4", len(words))
                doc = np.frombuffer(raw, "<u2", offset=4 * len(words))
                count = np.ascontiguousarray(np.frombuffer(unpack.decompress(row["counts"]), np.uint8).reshape(4, -1).T).view("<u4")[:, 0]
                pieces = np.repeat(np.array([known[w] for w in words], np.int64), per_word)
                sums = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(sums, doc, pieces * count)
                out.append((row["unit"], 1, press.compress(sums.astype("<i8").tobytes())))
            columns = list(zip(*out)) if out else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema)], schema=schema)
    return run


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (unit, kind): the documents of a unit, then its partial sums."""
    import zstandard

    unpack, current, total = zstandard.ZstdDecompressor(), None, None
    names = ["doc_id", "n_bytes", "n_tokens"]

    def emit() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([current.column("id"), current.column("bytes"), pa.array(total)], names=names)

    for batch in batches:
        for row in batch.to_pylist():
            raw = unpack.decompress(row["docs"])
            if row["kind"] == 0:
                if current is not None:
                    yield emit()
                with pa.ipc.open_stream(raw) as r:
                    current = r.read_next_batch()
                total = current.column("base").to_numpy().copy()
            else:
                part = np.frombuffer(raw, "<i8")
                total[:len(part)] += part
    if current is not None:
        yield emit()


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT,
                 path: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row; ``path``: the tokenizers file."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    blocks = source.mapInArrow(_frequencies(path, BUCKETS_PER_PARTITION * partitions), _BLOCK)
    sums = (blocks.repartition(partitions, "bucket")
            .mapInArrow(_count_pieces(path), "unit long, kind int, docs binary"))
    total = (sums.repartition(partitions, "unit").sortWithinPartitions("unit", "kind")
             .mapInArrow(_add_up, "doc_id long, n_bytes long, n_tokens long"))
    return total.withColumn("over_limit", F.col("n_tokens") > limit)
