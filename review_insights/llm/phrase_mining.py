"""Phrase collocations by SETM relational mining.

Occurrences are relations that are written, sorted by piece and position: a row
of ``R_1`` says that a word stands at a position of a piece.  Level by level,

* the groups of ``R_m`` (equal phrases of ``m`` words) are counted;
* ``R_m`` is semi-joined with the frequent groups, so that infrequent
  occurrences leave before anything is extended;
* the merge join of what is left with itself, by piece and adjacent position,
  gives ``R_{m+1}``: the phrases at ``p`` and ``p + 1`` share all but their ends.

The relations are stored in blocks of whole pieces (``BLOCK_BYTES`` of text).  A
block holds its occurrences in order as codes of its own, with a break where a
piece ends or a phrase is infrequent, so the merge join is a comparison of
neighbours and needs no shuffle.  Groups are counted in the block first; only
(group, block, count) is shuffled, as compressed lists by bucket of the word or of
the ids of both parts.  The semi-join sends the ids of frequent groups back to the
blocks that hold them.

A phrase is identified by its two parts of one word less, down to words, which
are compared by their bytes: no hash decides equality.  Counts, scores and the
comparison of cuts are integers throughout.

Scale: a word or phrase found everywhere is one row a block, not one an
occurrence.  A task holds one block, or the lists of one bucket
(``BUCKETS_PER_PARTITION`` for each shuffle partition).  The best phrases of a
language are taken in two levels.  Nothing is broadcast by this module, and the
driver sees no rows.

Defined results: texts are lower-cased in A-Z only; a null text has no words, a
null language is ``und``, as the one so named; repeated rows count again; a
language without candidates has no rows; a phrase stands inside a longer one if
its words do so contiguously; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from review_insights.llm.common import mix, packed, partition_id, saved, unpacked

MIN_COUNT = 10
MAX_WORDS = 3
TOP = 2_000
#: A candidate goes when a longer one around it has this share (in percent) of its count.
INSIDE_SHARE = 50
SCALE = 1_000_000
NO_LANG = "und"
#: Bytes of text in a block of the relations (a longer piece is a block of its own).
BLOCK_BYTES = 8 << 20
#: Buckets of groups for each shuffle partition.
BUCKETS_PER_PARTITION = 8
#: Languages after which a block ends.
MAX_LANGS = 1_000
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
BLANKS = " \t"

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in BLANKS]] = 1
_CLASS[[ord(c) for c in PIECE_ENDS]] = 2

_OCCURRENCES = np.dtype([("code", "<i4")])
_GROUPS = np.dtype([("grp", "<i8"), ("right", "<i8"), ("n", "<u4")])
_WORDS = np.dtype([("lang", "<u2"), ("n", "<u4")])
_BACK = np.dtype([("start", "<u4"), ("id", "<i8")])
_R1 = "block long, relation binary, bucket int, first long, groups binary, langs array<string>, words binary"
_RM = "block long, relation binary, bucket int, first long, groups binary"
_COUNTED_WORDS = "lang string, word binary, f long, id long, block long, back binary"
_COUNTED = "left long, right long, f long, id long, block long, back binary"


def words_of(text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of lower-cased bytes in order, and the number of piece ends before each."""
    kind = _CLASS[text]
    ink = kind == 0
    edge = np.diff(ink.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    letters = np.ascontiguousarray(text[ink])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(letters)])
    return words, np.searchsorted(np.flatnonzero(kind == 2), start)


def _whole_pieces(text: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Parts of a text of about ``limit`` bytes, cut at the ends of pieces only."""
    at = 0
    while len(text) - at > limit:
        ends = np.flatnonzero(_CLASS[text[at:at + limit]] == 2)
        step = limit
        while not len(ends) and at + step < len(text):
            ends = np.flatnonzero(_CLASS[text[at + step:at + step + limit]] == 2) + step
            ends, step = ends[:1], step + limit
        if not len(ends):
            break
        yield text[at:at + ends[-1] + 1]
        at += int(ends[-1]) + 1
    yield text[at:]


def _without_repeated_breaks(codes: np.ndarray) -> np.ndarray:
    keep = codes >= 0
    keep[1:] |= codes[:-1] >= 0
    return codes[keep]


def _stored(codes: np.ndarray) -> bytes:
    out = np.empty(len(codes), _OCCURRENCES)
    out["code"] = codes
    return packed(out)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _first_relation(limit: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        block = partition_id() << 32
        schema = pa.schema([("block", pa.int64()), ("relation", pa.binary()), ("bucket", pa.int32()), ("first", pa.int64()),
                            ("groups", pa.binary()), ("langs", pa.list_(pa.string())), ("words", pa.binary())])
        waiting: dict[str, list[np.ndarray]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal waiting, size, block
            relation, found, table, places = [], [], [], []
            gap = np.array([10], np.uint8)
            for k, (lang, texts) in enumerate(waiting.items()):
                words, piece = words_of(np.concatenate([x for t in texts for x in (t, gap)]))
                if not len(words):
                    continue
                coded = words.dictionary_encode()
                codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                breaks = np.concatenate([[0], np.cumsum(np.diff(piece) > 0)])
                out = np.full(len(codes) + int(breaks[-1]) + 1, -1, np.int32)
                out[np.arange(len(codes)) + breaks] = codes + len(found)
                relation.append(out)
                seed = zlib.crc32(lang.encode())
                places += [zlib.crc32(w, seed) % buckets for w in distinct]
                found += distinct
                own = np.empty(len(distinct), _WORDS)
                own["lang"], own["n"] = k, np.bincount(codes, minlength=len(distinct))
                table.append(own)
            langs, waiting, size = list(waiting), {}, 0
            if not found:
                return _batch([], schema)
            bucket = np.array(places)
            order = np.argsort(bucket, kind="stable")
            place = np.empty(len(order) + 1, np.int32)
            place[order], place[-1] = np.arange(len(order)), -1
            groups, edges = np.concatenate(table)[order], np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(block, _stored(place[np.concatenate(relation)]), None, None, None, None, None)]
            for b in np.flatnonzero(np.diff(edges)).tolist():
                cut = slice(edges[b], edges[b + 1])
                rows.append((block, None, b, int(edges[b]), packed(groups[cut]), langs, press.compress(b"\n".join([found[i] for i in order[cut]]))))
            block += 1
            return _batch(rows, schema)

        for batch in batches:
            for lang, data in zip(batch.column("lang").to_pylist(), batch.column("data")):
                text = _LOWER[np.frombuffer(data.as_buffer(), np.uint8)]
                for part in _whole_pieces(text, limit):
                    if size and (size + len(part) > limit or len(waiting) > MAX_LANGS):
                        yield flush()
                    waiting.setdefault(lang, []).append(part)
                    size += len(part) + 1
        yield flush()
    return run


def extended(codes: np.ndarray, frequent: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One block of ``R_{m+1}`` from ``R_m``: semi-join with the frequent groups (``frequent``: their codes,
    ``ids`` in ascending order), then the merge join of adjacent positions.  Returns the occurrences in order
    (-1: break) and, for each code, the ids of both parts and the count."""
    place = np.full(int(max(codes.max(initial=-1), frequent.max(initial=-1))) + 2, -1, np.int64)
    place[frequent] = np.arange(len(frequent))
    held = place[codes]  # a break takes the last entry, which is -1
    together = (held[:-1] >= 0) & (held[1:] >= 0)
    group, code, n = np.unique(held[:-1][together] * max(len(ids), 1) + held[1:][together], return_inverse=True, return_counts=True)
    out = np.full(len(codes), -1, np.int64)
    out[:-1][together] = code
    return _without_repeated_breaks(out), ids[group // max(len(ids), 1)], ids[group % max(len(ids), 1)], n


def _next_relation(buckets: int, last: bool):
    """Rows come sorted by block, the ids of its frequent groups before its occurrences."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("block", pa.int64()), ("relation", pa.binary()), ("bucket", pa.int32()), ("first", pa.int64()), ("groups", pa.binary())])
        known: list[tuple[np.ndarray, np.ndarray]] = []

        def block_rows(block: int, relation: bytes) -> pa.RecordBatch:
            frequent, ids = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*known)) if known else (np.zeros(0, np.int64),) * 2
            order = np.argsort(ids, kind="stable")
            codes, left, right, n = extended(unpacked(relation, _OCCURRENCES)["code"].astype(np.int64), frequent[order], ids[order])
            with np.errstate(over="ignore"):
                bucket = (mix(left.astype(np.uint64) + mix(right.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            table = np.empty(len(order), _GROUPS)
            table["grp"], table["right"], table["n"] = left[order], right[order], n[order]
            edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
            rows = [(block, None, b, int(edges[b]), packed(table[edges[b]:edges[b + 1]])) for b in np.flatnonzero(np.diff(edges)).tolist()]
            if not last and len(order):
                place = np.empty(len(order) + 1, np.int64)
                place[order], place[-1] = np.arange(len(order)), -1
                rows.append((block, _stored(place[codes]), None, None, None))
            return _batch(rows, schema)

        for batch in batches:
            for block, relation, back in zip(*(batch.column(c) for c in ("block", "relation", "back"))):
                if relation.is_valid:
                    yield block_rows(block.as_py(), relation.as_py())
                    known = []
                else:
                    table = unpacked(back.as_py(), _BACK)
                    known.append((table["start"].astype(np.int64), table["id"].astype(np.int64)))
    return run


def _numbered(order: np.ndarray, new: np.ndarray, n: np.ndarray, least: int, bucket: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted rows whose groups begin at ``new``: a row of each frequent group, its total and id; and every
    row's id (-1: infrequent)."""
    heads = np.flatnonzero(new)
    total = np.add.reduceat(n.astype(np.int64)[order], heads)
    frequent = total >= least
    number = np.where(frequent, (bucket << 32) + np.cumsum(frequent) - 1, -1)
    ids = np.empty(len(order), np.int64)
    ids[order] = number[np.cumsum(new) - 1]
    return order[heads[frequent]], total[frequent], number[frequent], ids


def _sent_back(lists: list[tuple], ids: np.ndarray) -> list[tuple[int, bytes]]:
    """For each block ``(block, codes and ids of its frequent groups)``; ``lists`` begin with block, first code and size."""
    out, at = [], 0
    for block, first, size, *_ in lists:
        own = ids[at:at + size]
        at += size
        places = np.flatnonzero(own >= 0)
        if len(places):
            back = np.empty(len(places), _BACK)
            back["start"], back["id"] = first + places, own[places]
            out.append((block, packed(back)))
    return out


def _by_bucket(read, flush):
    """Gather the lists of one bucket after the other (rows come sorted by bucket)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists = None, []
        for batch in batches:
            for values in zip(*batch.columns):
                row = {name: value.as_py() for name, value in zip(batch.schema.names, values)}
                if row["bucket"] != now and lists:
                    yield from flush(now, lists)
                    lists = []
                now = row["bucket"]
                lists.append(read(row))
        if lists:
            yield from flush(now, lists)
    return run


def _count_words(least: int):
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("f", pa.int64()), ("id", pa.int64()), ("block", pa.int64()), ("back", pa.binary())])

    def read(row):
        import zstandard

        words = zstandard.ZstdDecompressor().decompress(row["words"]).split(b"\n")
        return row["block"], row["first"], len(words), words, row["langs"], unpacked(row["groups"], _WORDS)

    def flush(bucket: int, lists: list[tuple]) -> Iterator[pa.RecordBatch]:
        langs = sorted({lang for x in lists for lang in x[4]})
        number = {lang: k for k, lang in enumerate(langs)}
        coded = pa.array([w for x in lists for w in x[3]], pa.binary()).dictionary_encode()
        word = coded.indices.to_numpy().astype(np.int64)
        lang = np.concatenate([np.array([number[g] for g in x[4]], np.int64)[x[5]["lang"]] for x in lists])
        n = np.concatenate([x[5]["n"] for x in lists]).astype(np.int64)
        order = np.lexsort((word, lang))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(lang[order]) != 0) | (np.diff(word[order]) != 0)
        kept, total, own, ids = _numbered(order, new, n, least, bucket)
        rows = [(langs[g], coded.dictionary[w].as_py(), f, i, None, None) for g, w, f, i in zip(lang[kept].tolist(), word[kept].tolist(), total.tolist(), own.tolist())]
        sums = np.zeros(len(langs), np.int64)
        np.add.at(sums, lang, n)
        rows += [(g, None, f, None, None, None) for g, f in zip(langs, sums.tolist()) if f]
        rows += [(None, None, None, None, block, back) for block, back in _sent_back(lists, ids)]
        yield _batch(rows, schema)
    return _by_bucket(read, flush)


def _count_groups(least: int, last: bool):
    """Counts of groups over all blocks, and the frequent ones back by block."""
    schema = pa.schema([("left", pa.int64()), ("right", pa.int64()), ("f", pa.int64()), ("id", pa.int64()), ("block", pa.int64()), ("back", pa.binary())])

    def read(row):
        table = unpacked(row["groups"], _GROUPS)
        return row["block"], row["first"], len(table), table

    def flush(bucket: int, lists: list[tuple]) -> Iterator[pa.RecordBatch]:
        left, right, n = (np.concatenate([x[3][c] for x in lists]) for c in ("grp", "right", "n"))
        order = np.lexsort((right, left))
        new = np.ones(len(order), bool)
        new[1:] = (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)
        kept, total, own, ids = _numbered(order, new, n, least, bucket)
        yield pa.RecordBatch.from_arrays([pa.array(left[kept]), pa.array(right[kept]), pa.array(total), pa.array(own),
                                          pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.binary())], schema=schema)
        if not last:
            yield _batch([(None, None, None, None, block, back) for block, back in _sent_back(lists, ids)], schema)
    return _by_bucket(read, flush)


def frequent_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS,
                     least: int = MIN_COUNT, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, list[DataFrame]]:
    """``(lang, n)``: all words of every language; and for each length ``m`` the frequent phrases
    ``(id, lang, phrase, last, f, first_counts, last_counts)``: the counts of the first 1 to ``m`` words and of the last."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"),
                         F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    buckets = BUCKETS_PER_PARTITION * partitions
    relation = saved(source.mapInArrow(_first_relation(block_bytes, buckets), _R1), "phrase-r1")
    groups = _dealt(relation, "block", "first", "groups", "langs", "words")
    counts = saved(groups.mapInArrow(_count_words(least), _COUNTED_WORDS), "phrase-words")
    totals = counts.where("lang IS NOT NULL AND id IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
    word, count = F.col("word").cast("string"), F.array("f")
    levels = [counts.where("id IS NOT NULL").select("id", "lang", word.alias("phrase"), word.alias("last"), "f",
                                                    count.alias("first_counts"), count.alias("last_counts"))]
    for m in range(2, max_words + 1):
        last = m == max_words
        back = counts.where("back IS NOT NULL").select("block", F.lit(None).cast("binary").alias("relation"), "back")
        occurrences = relation.where("relation IS NOT NULL").select("block", "relation", F.lit(None).cast("binary").alias("back"))
        sent = back.unionByName(occurrences).repartition("block").sortWithinPartitions("block", F.col("relation").isNotNull())
        relation = saved(sent.mapInArrow(_next_relation(buckets, last), _RM), f"phrase-r{m}")
        counts = saved(_dealt(relation, "block", "first", "groups").mapInArrow(_count_groups(least, last), _COUNTED), f"phrase-counts{m}")
        levels.append(saved(_named(counts.where("id IS NOT NULL").select("left", "right", "f", "id"), levels[-1]), f"phrase-names{m}"))
    return totals, levels


def _dealt(relation: DataFrame, *columns: str) -> DataFrame:
    """The groups of a relation by bucket."""
    return (relation.where("bucket IS NOT NULL").select("bucket", *columns)
            .repartition("bucket").sortWithinPartitions("bucket", "block"))


def _named(groups: DataFrame, shorter: DataFrame) -> DataFrame:
    """Phrases and counts of their parts, from the phrases of one word less."""
    left = shorter.select(F.col("id").alias("left"), "lang", "phrase", "first_counts")
    right = shorter.select(F.col("id").alias("right"), "last", "last_counts")
    return groups.join(left, "left").join(right, "right").select(
        "id", "left", "right", "lang", F.concat_ws(" ", "phrase", "last").alias("phrase"), "last", "f",
        F.concat("first_counts", F.array("f")).alias("first_counts"), F.concat("last_counts", F.array("f")).alias("last_counts"))


def _lowest_cut(m: int) -> Column:
    """The cut of phrases of ``m`` words with the least floored score, the smallest ``k`` among equal ones.
    Exact for counts below 10**16: products have at most 38 digits."""
    whole = "cast({} AS DECIMAL(19, 0))".format
    cuts = []
    for k in range(1, m):
        l, r = f"first_counts[{k - 1}]", f"last_counts[{m - k - 1}]"
        score = f"({whole('f')} * {whole('f')} * {SCALE}BD) div ({whole(l)} * {whole(r)})"
        cuts.append(f"named_struct('score', {score}, 'k', {k}, 'l', {l}, 'r', {r})")
    return F.expr(f"array_min(array({', '.join(cuts)}))")


def mine_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = MAX_WORDS, least: int = MIN_COUNT,
                 top: int = TOP, inside_share: int = INSIDE_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the first ``top`` phrases of every language."""
    totals, levels = frequent_phrases(docs, lang_col, text_col, max_words, least, block_bytes)
    found = None
    for m in range(2, max_words + 1):
        phrases = levels[m - 1].select("id", "lang", "phrase", F.col("f").alias("a"), _lowest_cut(m).alias("cut"))
        if m < max_words:
            # a phrase of two words more around this one holds one of one word more, at least as often
            longer = levels[m].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("around"))
            phrases = phrases.join(longer, "id", "left").where(F.col("around").isNull() | (100 * F.col("around") < inside_share * F.col("a")))
        phrases = phrases.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
        found = phrases if found is None else found.unionByName(phrases)
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near = Window.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(parts))).orderBy(*best)
    first = found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def phrases_sql(documents: str = "documents", max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP,
                inside_share: int = INSIDE_SHARE) -> str:
    """DuckDB twin, for ``max_words`` of 3."""
    assert max_words == 3
    return f"""
WITH texts AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '{NO_LANG}') AS lang,
         string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS pieces
  FROM {documents}),
pieces AS (SELECT lang, doc, unnest(range(len(pieces))) AS piece, string_split_regex(unnest(pieces), '[ \t]+') AS words FROM texts),
tokens AS (SELECT lang, doc, piece, unnest(range(len(words))) AS pos, unnest(words) AS w1 FROM pieces),
runs AS (
  SELECT lang, w1, lead(w1) OVER p AS w2, lead(w1, 2) OVER p AS w3 FROM tokens WHERE w1 <> ''
  WINDOW p AS (PARTITION BY doc, piece ORDER BY pos)),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= {least}),
around AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
pairs AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r
  FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
  LEFT JOIN around o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2
  WHERE o.f IS NULL OR 100 * o.f < {inside_share} * c.f),
triples AS (
  SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3 AS phrase, c.f AS a, x1.f AS l1, y1.f AS r1, x2.f AS l2, y2.f AS r2
  FROM f3 c JOIN f1 x1 ON x1.lang = c.lang AND x1.w1 = c.w1 JOIN f2 y1 ON y1.lang = c.lang AND y1.w1 = c.w2 AND y1.w2 = c.w3
  JOIN f2 x2 ON x2.lang = c.lang AND x2.w1 = c.w1 AND x2.w2 = c.w2 JOIN f1 y2 ON y2.lang = c.lang AND y2.w1 = c.w3),
scored AS (
  SELECT lang, phrase, a, l, r, {SCALE}::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM pairs
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2)
  FROM (SELECT *, {SCALE}::HUGEINT * a * a // (l1::HUGEINT * r1) AS s1, {SCALE}::HUGEINT * a * a // (l2::HUGEINT * r2) AS s2 FROM triples)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM scored)
SELECT lang, rank, phrase, a, l, r, (SELECT sum(f)::BIGINT FROM f1 WHERE f1.lang = ranked.lang) AS n, score::BIGINT AS score
FROM ranked WHERE rank <= {top}
"""
