"""Keywords kept up to date batch by batch.

The weight of a term in a document depends on the whole vocabulary, so term counts
alone do not give the importances of K1 to K6.  What a batch stores is what later runs
would have to make again from its texts: the tokens of its documents without stop
words, and the counts of their terms.  Keywords of all reviews so far then come from
the sum of the counts (class sizes, vocabulary) and one pass over stored tokens; no
text is read, cleaned or split again.  Batches are stored and folded as in
:mod:`review_insights.streaming.state`: a replayed batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from review_insights.functions.text import with_bigrams
from review_insights.operators import keywords
from review_insights.streaming.state import fold, read_frames, store_frames


def store_batch(scored: DataFrame, path: str, batch_id: int, text_col: str = "review_text", sentiment_col: str = "bert_sentiment",
                stop_words: Sequence[str] | None = None) -> bool:
    """Store the tokens and term counts of one batch; False if it is stored already."""
    def frames() -> dict[str, DataFrame | Callable[[str], DataFrame]]:
        docs = keywords.keyword_documents(scored, text_col, sentiment_col)
        tokens = docs.select(F.struct(F.lit(batch_id).cast("long").alias("batch"), F.col("doc_id").alias("doc")).alias("doc_id"), "sentiment",
                             keywords.kept_tokens(F.col("processed_text"), stop_words).alias("tokens"))

        # counts and sizes come from the stored tokens: the batch is read, cleaned and split once
        def stored(location: str) -> DataFrame:
            return scored.sparkSession.read.schema(tokens.schema).parquet(f"{location}/tokens")

        return {"tokens": tokens,
                "counts": lambda at: keywords.term_counts(stored(at).select("sentiment", with_bigrams(F.col("tokens")).alias("terms"))),
                "sizes": lambda at: keywords.class_sizes(stored(at)).coalesce(1)}

    return store_frames(scored.sparkSession, path, batch_id, frames)


def _merged(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    counts = read_frames(spark, path, "counts").groupBy("sentiment", "term").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    sizes = read_frames(spark, path, "sizes").groupBy("sentiment").agg(F.sum("n").alias("n"))
    return {"tokens": read_frames(spark, path, "tokens"), "counts": counts, "sizes": sizes}


def compact(spark: SparkSession, path: str) -> int:
    """Fold the stored batches into one."""
    def merged() -> dict[str, DataFrame]:
        found = _merged(spark, path)
        return found | {"sizes": found["sizes"].coalesce(1)}

    return fold(spark, path, merged)


def current_keywords(spark: SparkSession, path: str, top_k: int = keywords.K.TFIDF_TOP_K, max_features: int = keywords.K.TFIDF_MAX_FEATURES,
                     min_df: int = keywords.K.TFIDF_MIN_DF, max_df: float = keywords.K.TFIDF_MAX_DF) -> DataFrame:
    """``(sentiment, rank, term, importance)`` of all reviews stored so far."""
    found = _merged(spark, path)
    vocab = keywords.vocabulary_of(found["counts"], found["sizes"], max_features, min_df, max_df)
    terms = found["tokens"].select("doc_id", "sentiment", with_bigrams(F.col("tokens")).alias("terms"))
    return keywords.ranked(keywords.weighted(terms, vocab), top_k)


def start_keywords(scored_stream: DataFrame, path: str, checkpoint_location: str, available_now: bool = True) -> StreamingQuery:
    """Keep the state at ``path`` up to date with a stream of scored reviews."""
    writer = (scored_stream.writeStream.option("checkpointLocation", checkpoint_location)
              .foreachBatch(lambda batch, batch_id: store_batch(batch, path, batch_id)))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
