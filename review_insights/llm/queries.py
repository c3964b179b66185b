"""Registered corpus queries: each applies one operator, with production
parameters, to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from review_insights.llm import (conversation_repair, group_join, langid, line_quality, lpf_dedup, mixing, packing, pattern_packing,
                                 phrase_mining, radix_dedup, token_counts, toxicity, wrapper_induction)
from review_insights.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


@register("op1_mixing", mixing.mixing_sql())
def op1_mixing(spark, sf_dir):
    """Raked mixture of sources, languages and topics with the sampling decision of every document."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    """Fitted on labelled rows outside the held-out fold only."""
    sample = toxicity.training_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                                      fold("id", 3) != 1)
    return toxicity.fit(*sample)


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir):
    """Toxicity score of every document."""
    scored = toxicity.score_documents(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score",
                         (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@register("op3_exact_dedup", """
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
""")
def op3_exact_dedup(spark, sf_dir):
    """Group, survivor and digest of every document."""
    groups = radix_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op4_packing")
def op4_packing(spark, sf_dir):
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


@register("op9_ngram_join")
def op9_ngram_join(spark, sf_dir):
    """Near-duplicate component of every document: 4-word shingles, Jaccard of 0.85."""
    found = group_join.near_duplicate_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100)
    return found.select("doc_id", "n_shingles", "component_id")


@register("op5_lpf_dedup")
def op5_lpf_dedup(spark, sf_dir):
    """Bytes of every document without repeated strings of 100 bytes."""
    return lpf_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@register("op6_token_counts")
def op6_token_counts(spark, sf_dir):
    """Token counts of every document."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@register("op7_line_quality", line_quality.line_quality_sql())
def op7_line_quality(spark, sf_dir):
    """Line rules and verdict for every document."""
    return line_quality.line_quality(table(spark, sf_dir, "documents"))


@register("op8_language_id")
def op8_language_id(spark, sf_dir):
    """Language of every document, learned outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(*langid.training_sample(docs, fold("id", 4) != 2))
    found = langid.predict_languages(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


@register("op10_wrapper_induction")
def op10_wrapper_induction(spark, sf_dir):
    """Main text of every page."""
    return wrapper_induction.extract_text(table(spark, sf_dir, "pages"))


@register("op13_pattern_packing")
def op13_pattern_packing(spark, sf_dir):
    """Pieces of all documents in as few sequences of 1024 tokens as the fitted patterns need."""
    return pattern_packing.pack_patterns(table(spark, sf_dir, "documents"))


@register("op11_phrase_mining", phrase_mining.phrases_sql())
def op11_phrase_mining(spark, sf_dir):
    """Best phrases of two and three words of every language."""
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


@register("op12_conversation_repair")
def op12_conversation_repair(spark, sf_dir):
    """Faults, cheapest edits and repaired digest of every conversation, after the damage."""
    return conversation_repair.repair_report(conversation_repair.damaged(table(spark, sf_dir, "conversations")))
