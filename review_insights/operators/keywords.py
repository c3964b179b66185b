"""TF-IDF keywords per sentiment class (K1..K6), as relational algebra.

Semantics per class (documents = reviews of that sentiment):
* text: characters outside letters/whitespace deleted, lower-cased; null -> ''
* terms: tokens of >= 2 letters, stop words removed, then unigrams + bigrams
* vocabulary: document frequency df >= min_df and df <= max_df * n, then the
  ``max_features`` terms with the highest total count (ties alphabetical);
  a class with max_df * n < min_df, or no surviving term, yields nothing
* weight: tf * (ln((1 + n) / (1 + df)) + 1), L2-normalised per document over
  the kept vocabulary; importance = sum of weights / n (all documents)
* output: top ``top_k`` terms per class by importance, ties alphabetical

Physical shape: two passes read the documents.  The vocabulary pass tokenises
rows where they are, in Arrow batches (:func:`piece_counts`): the terms of a run of
documents are counted with numpy, so Spark joins and adds up the distinct terms of
each run by (class, term).  The weighting pass tokenises again and keeps
vocabulary terms only; their integer ids are gathered into one row per document
where it is read (:func:`_kept_rows`), hash-partitioned by document once, and
per-document term counts, norms and the sums of a task are made there in Arrow
batches (:func:`_weight_sums`).  No text is ever shuffled.  The vocabulary is found with map-side
partial aggregation and cut to at most ``max_features`` rows per class by a
two-level top-k (as many buckets as shuffle partitions, then per class), so no task ever holds a
whole class; only that bounded vocabulary is broadcast.

Texts of many rare terms: with ``sketch`` the rare ones are never shuffled.

* The most frequent terms of one document in ``SAMPLE_ONE_IN`` are candidates.
* One pass counts the candidates exactly, and adds up all other terms in
  ``SKETCH_WIDTH`` buckets per class by a hash: a bucket's counts bound those of
  each of its terms from above.
* The ``max_features``-th total among the eligible candidates is a floor that every
  kept term reaches, so only the candidates at the floor or above and terms in buckets
  at the floor or above are counted one by one, in a second pass.

The rows are the same; what is shuffled is in proportion to tasks and buckets,
and the sample, instead of all rare bigrams.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from review_insights import constants as K
from review_insights.functions.stopwords import english_stop_words
from review_insights.functions.text import keyword_clean, with_bigrams, word_tokens


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    split_col: str, buckets: int | None = None, rank_name: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group, without sending a whole group to one task.

    Stage 1 ranks inside (group, hash bucket of ``split_col``) and keeps k per
    bucket; stage 2 ranks the at most ``buckets * k`` survivors per group.  The
    result equals a plain per-group ``row_number() <= k`` for a total order.
    """
    buckets = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bucket = F.pmod(F.xxhash64(F.col(split_col)), F.lit(buckets))
    w1 = Window.partitionBy(*[F.col(g) for g in group], bucket).orderBy(*order)
    stage1 = df.withColumn("_tk_rn", F.row_number().over(w1)).where(F.col("_tk_rn") <= k).drop("_tk_rn")
    w2 = Window.partitionBy(*group).orderBy(*order)
    return stage1.withColumn(rank_name, F.row_number().over(w2).cast("bigint")).where(F.col(rank_name) <= k)


def keyword_documents(df: DataFrame, text_col: str = "review_text", sentiment_col: str = "bert_sentiment",
                      key: str | None = None) -> DataFrame:
    """``(doc_id, sentiment, text, processed_text)`` for rows of the three sentiment classes.

    Every row is one document.  Without a ``key`` known to be unique, documents
    get a row identity from ``monotonically_increasing_id()`` assigned right at
    the scan, before any shuffle (so a recomputed task reproduces it); review ids
    are not relied on because duplicated ids would merge two documents.
    """
    doc_id = F.col(key) if key else F.monotonically_increasing_id()
    # a class that is itself computed from the text (a lexicon) is computed once a row: a filter on it would be
    # moved below the scorer and hold a copy of the scorer for each use, so the class passes a generator first
    classed = df.select(*([key] if key else []), F.col(text_col).alias("_text"), F.explode_outer(F.array(sentiment_col)).alias("sentiment"))
    return (classed.where(F.col("sentiment").isin(*K.SENTIMENTS))
            .select(doc_id.alias("doc_id"), "sentiment", F.col("_text").alias("text"), keyword_clean(F.col("_text")).alias("processed_text")))


def document_terms(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """Add ``terms``: stop-word-free tokens followed by their adjacent bigrams."""
    toks = docs.withColumn("_tokens", kept_tokens(F.col("processed_text"), stop_words))
    return toks.withColumn("terms", with_bigrams(F.col("_tokens"))).drop("_tokens")


def kept_tokens(processed: Column, stop_words: Sequence[str] | None = None) -> Column:
    """Tokens without stop words, in order."""
    stop = list(stop_words if stop_words is not None else english_stop_words())
    return F.filter(word_tokens(processed), lambda x: ~x.isin(stop))


def class_sizes(docs: DataFrame) -> DataFrame:
    """Documents per class (at most three rows)."""
    return docs.groupBy("sentiment").agg(F.count(F.lit(1)).alias("n"))


def term_occurrences(terms: DataFrame) -> DataFrame:
    """``(sentiment, term, first)``: one row per term occurrence, ``first`` set on
    the first occurrence of a term within its document.

    Each document's terms are sorted so equal terms are adjacent; an occurrence
    is the first when the previous element differs.  This gives document
    frequencies from the same single explode as term totals (O(n log n) per
    document), with no per-document aggregation.
    """
    ordered = terms.select("sentiment", F.sort_array("terms").alias("_sorted"))
    # one place later the array of the previous elements, without a lambda per element; its end pairs with null
    pairs = F.arrays_zip(F.col("_sorted").alias("term"), F.concat(F.array(F.lit(None).cast("string")), F.col("_sorted")).alias("before"))
    # outer: a plain explode makes the optimizer copy the tokeniser into a filter
    occ = ordered.select("sentiment", F.explode_outer(pairs).alias("o"))
    return (occ.select("sentiment", F.col("o.term").alias("term"), (~F.col("o.term").eqNullSafe(F.col("o.before"))).alias("first"))
            .where(F.col("term").isNotNull()))


#: Buckets of the sketch per class, the share of documents that name candidates, and how many for each kept term.
SKETCH_WIDTH = 1 << 16
SAMPLE_ONE_IN = 16
CANDIDATES = 4


def _counts(occurrences: DataFrame, *keys: str) -> DataFrame:
    return occurrences.groupBy("sentiment", *keys).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("first")).alias("df"))


def term_counts(terms: DataFrame) -> DataFrame:
    """``(sentiment, term, total, df)`` of every term."""
    return _counts(term_occurrences(terms), "term")


#: Bytes of text whose terms are found at once.
PIECE_BYTES = 8 << 20

#: What a byte of a text becomes: a small letter, a space, or nothing.
_BYTES = np.zeros(256, np.uint8)
for _letter in range(ord("a"), ord("z") + 1):
    _BYTES[[_letter, _letter - 32]] = _letter
_BYTES[[9, 10, 11, 12, 13, 32]] = 32
#: White space beyond ASCII, by its first byte.
_WIDE_SPACES: dict[int, list[bytes]] = {}
for _space in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
    _WIDE_SPACES.setdefault(chr(_space).encode()[0], []).append(chr(_space).encode())


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``PIECE_BYTES`` of text in the last column, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_BYTES, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def _piece_tokens(texts: pa.Array, stop: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Document and word of every kept token of the texts, and the words: the tokens of :func:`kept_tokens`."""
    values = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    chars = _BYTES[data]
    for lead, spaces in _WIDE_SPACES.items():
        at = np.flatnonzero(data == lead)
        for space in spaces if len(at) else ():
            same = at[at + len(space) <= len(data)]
            for k in range(1, len(space)):
                same = same[data[same + k] == space[k]]
            chars[same] = 32
    kept = np.flatnonzero(chars)
    # a space before each document, so that no token goes on in the next one
    begins = np.searchsorted(kept, offsets[:-1] - offsets[0])
    chars = np.append(np.insert(chars[kept], begins, 32), np.uint8(32))
    turns = np.flatnonzero((chars[1:] != 32) != (chars[:-1] != 32)) + 1
    starts, lengths = turns[::2], turns[1::2] - turns[::2]
    document = np.searchsorted(begins + np.arange(len(begins)), starts, "right") - 1
    long = lengths >= 2
    letters = chars[chars != 32][np.repeat(long, lengths)]
    tokens = pa.LargeStringArray.from_buffers(int(long.sum()), pa.py_buffer(np.concatenate([[0], np.cumsum(lengths[long])]).astype(np.int64)),
                                              pa.py_buffer(letters)).dictionary_encode()
    words = tokens.dictionary.cast(pa.string())
    word = tokens.indices.to_numpy().astype(np.int64)
    good = ~pc.is_in(words, value_set=stop).to_numpy(zero_copy_only=False)[word]
    return document[long][good], word[good], words


def _numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small numbers for the values, and the values by number."""
    coded = pa.array(values).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_numpy()


def _piece_terms(classes: pa.Array, texts: pa.Array, stop: pa.Array) -> tuple:
    """Terms of some documents, tokens and adjacent pairs: the document and how often, by ``(class, term)`` and
    document, then the places where a ``(class, term)`` begins, and its class and term."""
    document, word, words = _piece_tokens(texts, stop)
    pair = np.flatnonzero(document[1:] == document[:-1])
    # a pair of words, or no word and a word, as one number
    code, terms = _numbered(np.concatenate([word, (word[pair] + 1) * len(words) + word[pair + 1]]))
    document = np.concatenate([document, document[pair]])
    names = classes.dictionary_encode()
    kind = names.indices.to_numpy().astype(np.int64)[document]
    found, times = np.unique((kind * len(terms) + code) * len(texts) + document, return_counts=True)
    group, document = np.divmod(found, len(texts))
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    kind, code = np.divmod(group[starts], max(len(terms), 1))
    first, second = np.divmod(terms[code], max(len(words), 1))
    last = words.take(pa.array(second))
    pairs = pc.binary_join_element_wise(words.take(pa.array(np.maximum(first - 1, 0))), last, " ")
    return document, times, starts, names.dictionary.take(pa.array(kind)), pc.if_else(pa.array(first == 0), last, pairs)


def _stop_array(stop_words: Sequence[str] | None) -> pa.Array:
    return pa.array(list(stop_words if stop_words is not None else english_stop_words()), pa.string())


def piece_counts(docs: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(sentiment, term, total, df)`` to be summed: a row for every distinct term of a run of documents, from
    :func:`keyword_documents`.  What is joined and added up by term are these rows, not all occurrences."""
    stop = _stop_array(stop_words)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            document, times, starts, classes, terms = _piece_terms(piece.column(0), piece.column(1), stop)
            if len(starts):
                yield pa.RecordBatch.from_arrays([classes, terms, pa.array(np.add.reduceat(times, starts)), pa.array(
                    np.diff(starts, append=len(document)))], ["sentiment", "term", "total", "df"])

    return docs.select("sentiment", "text").mapInArrow(counts, "sentiment string, term string, total long, df long")


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("sentiment", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))


def _eligible(counts: DataFrame, sizes: DataFrame, min_df: int, max_df: float) -> DataFrame:
    high = F.lit(float(max_df)) * F.col("n")
    return (counts.join(F.broadcast(sizes), "sentiment")
            .where((F.col("df") >= min_df) & (F.col("df") <= high) & (high >= min_df)))


def sketched_counts(docs: DataFrame, sizes: DataFrame, max_features: int, min_df: int, max_df: float,
                    stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(sentiment, term, total, df)`` of every term that can be in the vocabulary; ``docs``: as from
    :func:`keyword_documents`."""
    part = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE_ONE_IN)) == 0)
    # bounded: CANDIDATES * max_features rows per class, three classes
    candidates = F.broadcast(top_k_per_group(_summed(piece_counts(part, stop_words)), ["sentiment"], [F.desc("total"), F.asc("term")],
                                             CANDIDATES * max_features, split_col="term").select("sentiment", "term", F.lit(True).alias("named")))
    bucket = F.pmod(F.xxhash64("term"), F.lit(SKETCH_WIDTH)).cast("int")
    counts = piece_counts(docs, stop_words).withColumn("bucket", bucket).join(candidates, ["sentiment", "term"], "left")
    # a row is counted as its candidate, or in its bucket; keys without nulls
    counts = counts.withColumns({"sentiment": F.coalesce("sentiment", F.lit("")),
                                 "name": F.coalesce(F.when(F.col("named"), F.col("term")), F.lit("")),
                                 "bucket": F.coalesce(F.when(F.col("named").isNull(), F.col("bucket")), F.lit(-1))})
    keys = ["sentiment", "name", "bucket"]
    # bounded: SKETCH_WIDTH and CANDIDATES * max_features rows per class.  Read once, so that one pass makes them
    counted = counts.groupBy(*keys).agg(F.sum("total").alias("total"), F.sum("df").alias("df")).join(F.broadcast(sizes), "sentiment")
    high = F.lit(float(max_df)) * F.col("n")
    eligible = (F.col("df") >= min_df) & (F.col("df") <= high) & (high >= min_df)
    ranked_rows = counted.withColumn("can", (F.col("bucket") == -1) & eligible).withColumn(
        "place", F.row_number().over(Window.partitionBy("sentiment", "can").orderBy(F.desc("total"), F.asc("name"), F.asc("bucket"))))
    floor = F.max(F.when(F.col("can") & (F.col("place") == max_features), F.col("total"))).over(Window.partitionBy("sentiment"))
    kept = ranked_rows.withColumn("floor", F.coalesce(floor, F.lit(1))).where(
        (F.col("total") >= F.col("floor")) & F.when(F.col("bucket") == -1, F.col("can")).otherwise(F.col("df") >= min_df))
    return _summed(counts.join(F.broadcast(kept.select(*keys)), keys, "left_semi"))


def vocabulary(docs: DataFrame, sizes: DataFrame, max_features: int = K.TFIDF_MAX_FEATURES,
               min_df: int = K.TFIDF_MIN_DF, max_df: float = K.TFIDF_MAX_DF, sketch: bool = False,
               stop_words: Sequence[str] | None = None) -> DataFrame:
    """Kept vocabulary ``(sentiment, term, df, total, n, idf)``, <= max_features per class.

    Term totals (all occurrences) and document frequencies (first occurrences)
    come from one partially-aggregated pass over the documents; with
    ``sketch`` only of the terms that :func:`sketched_counts` leaves.
    """
    counts = (sketched_counts(docs, sizes, max_features, min_df, max_df, stop_words) if sketch
              else _summed(piece_counts(docs, stop_words)))
    return vocabulary_of(counts, sizes, max_features, min_df, max_df)


def vocabulary_of(counts: DataFrame, sizes: DataFrame, max_features: int = K.TFIDF_MAX_FEATURES,
                  min_df: int = K.TFIDF_MIN_DF, max_df: float = K.TFIDF_MAX_DF) -> DataFrame:
    """The kept vocabulary from ``(sentiment, term, total, df)``."""
    eligible = _eligible(counts, sizes, min_df, max_df)
    kept = top_k_per_group(eligible, ["sentiment"], [F.desc("total"), F.asc("term")], max_features,
                           split_col="term", rank_name="vocab_rank")
    # a compact integer id per kept term: class position * (max_features + 1) + rank
    code = F.array_position(F.array(*[F.lit(c) for c in K.SENTIMENTS]), F.col("sentiment"))
    return kept.withColumns({
        "idf": F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1,
        "term_id": (code * (max_features + 1) + F.col("vocab_rank")).cast("int"),
    })


def keyword_importance(df: DataFrame, text_col: str = "review_text", sentiment_col: str = "bert_sentiment",
                       key: str | None = None, max_features: int = K.TFIDF_MAX_FEATURES,
                       min_df: int = K.TFIDF_MIN_DF, max_df: float = K.TFIDF_MAX_DF,
                       stop_words: Sequence[str] | None = None, num_partitions: int | None = None,
                       sketch: bool = False) -> DataFrame:
    """Mean TF-IDF weight of every kept term: ``(sentiment, term, importance)``.  ``sketch``: a pass
    more over the documents, for texts of many rare terms (same result)."""
    docs = keyword_documents(df, text_col, sentiment_col, key)
    # class sizes and the vocabulary only need row-local tokenising and partial
    # aggregation: they read the documents where they are, without a shuffle
    sizes = class_sizes(docs)
    vocab = vocabulary(docs, sizes, max_features, min_df, max_df, sketch, stop_words)
    return _importance(_kept_rows(docs, vocab, stop_words), vocab, num_partitions)


def _kept_rows(docs: DataFrame, vocab: DataFrame, stop_words: Sequence[str] | None = None) -> DataFrame:
    """``(doc_id, ids, idfs)``: the vocabulary terms of every document that has any, each as often as it occurs.

    The distinct terms of a run of documents, with their places, are joined with the vocabulary; the terms of
    a run follow each other, so its documents are put together again without a shuffle.
    """
    stop = _stop_array(stop_words)

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, piece in enumerate(_pieces(batches)):
            document, times, starts, classes, terms = _piece_terms(piece.column(1), piece.column(2), stop)
            if len(starts):
                offsets = pa.array(np.append(starts, len(document)), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), part, np.int64)), classes, terms, *(
                    pa.ListArray.from_arrays(offsets, c) for c in (pa.array(document, pa.int32()), piece.column(0).take(pa.array(document)),
                                                                   pa.array(times, pa.int32())))],
                    ["part", "sentiment", "term", "places", "docs", "times"])

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            part = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if held and held[-1].column(0)[0].as_py() != part[lo]:
                        yield _run_rows(held)
                        held = []
                    held.append(batch.slice(lo, hi - lo))
        if held:
            yield _run_rows(held)

    key = docs.schema["doc_id"].dataType
    found = docs.select("doc_id", "sentiment", "text").mapInArrow(postings, T.StructType([
        T.StructField("part", T.LongType()), T.StructField("sentiment", T.StringType()), T.StructField("term", T.StringType()),
        T.StructField("places", T.ArrayType(T.IntegerType())), T.StructField("docs", T.ArrayType(key)), T.StructField("times", T.ArrayType(T.IntegerType()))]))
    # bounded: at most max_features rows per class, three classes; terms outside the vocabulary end here
    hits = found.join(F.broadcast(_compact(vocab)), ["sentiment", "term"]).select("part", "places", "docs", "times", "term_id", "idf")
    return hits.mapInArrow(documents, T.StructType([T.StructField("doc_id", key), T.StructField("ids", T.ArrayType(T.IntegerType())),
                                                    T.StructField("idfs", T.ArrayType(T.DoubleType()))]))


def _compact(vocab: DataFrame) -> DataFrame:
    return vocab.select("sentiment", "term", "term_id", "idf", "n")


def _run_rows(part: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each document of a run, from ``(part, places, docs, times, term_id, idf)`` of its terms."""
    lengths = np.concatenate([b.column(1).value_lengths().to_numpy() for b in part])
    place, times = (np.concatenate([b.column(k).flatten().to_numpy() for b in part]) for k in (1, 3))
    order = np.argsort(place, kind="stable")
    ids, idfs = (np.repeat(np.repeat(np.concatenate([b.column(k).to_numpy() for b in part]), lengths)[order], times[order]) for k in (4, 5))
    starts = np.flatnonzero(np.diff(place[order], prepend=-1))
    offsets = pa.array(np.concatenate([[0], np.cumsum(np.add.reduceat(times[order], starts))]), pa.int32())
    keys = pa.concat_arrays([b.column(2).flatten() for b in part]).take(pa.array(order[starts]))
    return pa.RecordBatch.from_arrays([keys, *(pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (ids, idfs))], ["doc_id", "ids", "idfs"])


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(doc_id, ids, idfs)``: one row for each run of equal ``row`` in ``(row, doc_id, term_id, idf)``."""
    for batch in batches:
        if batch.num_rows:
            row = batch.column(0).to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(row[1:] != row[:-1]) + 1])
            offsets = pa.array(np.append(starts, len(row)), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(starts)), *(
                pa.ListArray.from_arrays(offsets, batch.column(k)) for k in (2, 3))], ["doc_id", "ids", "idfs"])


def _document_weights(parts: list[tuple[np.ndarray, ...]], sums: np.ndarray) -> np.ndarray:
    """Add the weights of whole documents, as ``(document, term_id, idf)``, to the sums by term id."""
    doc, term, idf = (np.concatenate(c) for c in zip(*parts))
    width = int(term.max()) + 1
    place = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    idf_of = np.zeros(width)
    idf_of[term] = idf
    found, tf = np.unique(place * width + term, return_counts=True)
    place, term = found // width, found % width
    w = tf * idf_of[term]
    weight = w / np.sqrt(np.bincount(place, w * w))[place]
    if width > len(sums):
        sums = np.concatenate([sums, np.zeros(width - len(sums))])
    return sums + np.bincount(term, weight, minlength=len(sums))


def _weight_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(term_id, weight_sum)`` of a task, from ``(first, ids, idfs)`` with the rows of a document one after
    the other, the first marked.  Held: one batch, the document it ends in, and one sum per term."""
    sums, rest, documents = np.zeros(0), [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        number = documents + np.cumsum(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))
        documents = int(number[-1])
        ids, idfs = batch.column(1), batch.column(2)
        part = (np.repeat(number, ids.value_lengths().to_numpy()), ids.flatten().to_numpy().astype(np.int64), idfs.flatten().to_numpy())
        # the last document may go on in the next batch
        cut = int(np.searchsorted(part[0], documents))
        whole = rest + [tuple(c[:cut] for c in part)] if cut else rest
        if cut or (rest and rest[-1][0][-1] != documents):
            sums, rest = _document_weights(whole, sums), []
        rest.append(tuple(c[cut:] for c in part))
    if rest:
        sums = _document_weights(rest, sums)
    ids = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(sums[ids], pa.float64())], ["term_id", "weight_sum"])


def weighted(terms: DataFrame, vocab: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Mean TF-IDF weight of every term of the vocabulary, from ``(doc_id, sentiment, terms)``."""
    vocab = _compact(vocab)
    # a number given before the explode: the occurrences of a document have it and follow each other
    numbered = terms.select(F.monotonically_increasing_id().alias("row"), "doc_id", "sentiment", "terms")
    # bounded: at most max_features rows per class, three classes.  Terms outside
    # the vocabulary are dropped where the document is read, so the one shuffle
    # carries one row of ids per document and no text; afterwards each document's
    # term counts and norm stay inside one partition
    hits = (numbered.select("row", "doc_id", "sentiment", F.explode_outer("terms").alias("term"))
            .where(F.col("term").isNotNull()).join(F.broadcast(vocab), ["sentiment", "term"])
            .select("row", "doc_id", "term_id", "idf"))
    rows = hits.mapInArrow(_document_rows, T.StructType([
        hits.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("idfs", T.ArrayType(T.DoubleType()))]))
    return _importance(rows, vocab, num_partitions)


def _importance(rows: DataFrame, vocab: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """Mean weights from ``(doc_id, ids, idfs)``."""
    vocab = _compact(vocab)
    rows = rows.repartition(num_partitions, "doc_id") if num_partitions else rows.repartition("doc_id")
    # rows with the same doc_id are one document
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("doc_id")) == 1
    weights = rows.select(first.alias("first"), "ids", "idfs").mapInArrow(_weight_sums, "term_id int, weight_sum double")
    sums = weights.groupBy("term_id").agg(F.sum("weight_sum").alias("weight_sum"))
    # the same broadcast as above (one vocabulary pass, reused exchange)
    # the class passes a generator: a caller's filter on it would reach only this use of the vocabulary, which is then made twice
    return (sums.join(F.broadcast(vocab), "term_id")
            .select(F.explode_outer(F.array("sentiment")).alias("sentiment"), "term", (F.col("weight_sum") / F.col("n")).alias("importance")))


def extract_keywords(df: DataFrame, top_k: int = K.TFIDF_TOP_K, **kwargs) -> DataFrame:
    """Top ``top_k`` keywords per sentiment: ``(sentiment, rank, term, importance)``.

    Ranking compares importances rounded to 10 decimals so that terms whose
    weights are equal up to summation order tie, and ties go alphabetically.
    """
    return ranked(keyword_importance(df, **kwargs), top_k)


def ranked(imp: DataFrame, top_k: int = K.TFIDF_TOP_K) -> DataFrame:
    """The first ``top_k`` terms of every class."""
    w = Window.partitionBy("sentiment").orderBy(F.desc(F.round("importance", 10)), F.asc("term"))
    # at most max_features rows per class reach this window
    return (imp.withColumn("rank", F.row_number().over(w).cast("bigint")).where(F.col("rank") <= top_k)
            .select("sentiment", "rank", "term", "importance"))
