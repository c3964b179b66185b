"""Mixing sources to target weights: iterative proportional fitting of token
weights to source, language and topic marginals, then a sample of documents by
calibrated probabilities.

1. One pass sums the tokens of every cell (source, language, topic) with
   map-side partial aggregation.  Categories that the targets do not name go
   to ``other``, so the number of cells is bounded by the targets alone
   (their sizes multiplied), whatever the corpus holds.
2. The cells are raked: each round scales them to the source, the language and
   the topic marginal in turn.  Targets are taken over the categories that
   have tokens.  ``rate`` of a cell is its raked share over its own share.
3. The probability of a document is ``min(1, scale * rate)``; ``scale`` is
   solved exactly so that the expected tokens equal the budget (cells whose
   probability would pass 1 are kept whole and the rest scaled up).  ``weight``
   is ``scale * rate / probability``: with it the sample meets the marginals
   in expectation also where the probability was held at 1.
4. A second pass keeps a document when a hash of its id is below its
   probability; the cell table, bounded as said, is broadcast.

Tokens are estimated as UTF-8 bytes / 4, rounded up.  Everything on the rows
is DataFrame expressions; the SQL twin is :func:`mixing_sql`.

Defined results: null source, language or topic counts as ``other``; a null or
empty text has 0 tokens and gets its cell's probability (1 if the cell has no
tokens); repeated rows are drawn alike, as the draw depends on the id only;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from review_insights.llm.common import unused

OTHER = "other"
SOURCE_TARGETS = {"src0": 0.12, **{f"src{i}": 0.045 for i in range(1, 20)}, OTHER: 0.025}
LANG_TARGETS = {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.13, OTHER: 0.02}
TOPIC_TARGETS = {"prose": 0.7, "tabular": 0.1, "legal": 0.1, "web": 0.1}
ROUNDS = 25
BUDGET_SHARE = 0.7
SEED = "mix-1"
BYTES_PER_TOKEN = 4
_DRAW_BITS = 52


def topic_of(text: Column) -> Column:
    """Topic by form: licence lines, tables, links and addresses, else prose."""
    t = F.coalesce(text, F.lit(""))
    return (F.when(t.contains("License"), "legal").when(t.contains(" | "), "tabular")
            .when(t.contains("http") | t.contains("@"), "web").otherwise("prose"))


def token_weight(text: Column) -> Column:
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / F.lit(BYTES_PER_TOKEN)).cast("long")


def named(value: Column, targets: Mapping[str, float]) -> Column:
    return F.when(value.isin(*[k for k in targets if k != OTHER]), value).otherwise(F.lit(OTHER))


def rake(tokens: np.ndarray, axes: list[np.ndarray], targets: list[np.ndarray], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights whose marginals follow ``targets``; ``axes[k]`` is the category
    of each cell on axis k."""
    w = tokens / tokens.sum()
    for _ in range(rounds):
        for axis, target in zip(axes, targets):
            have = np.bincount(axis, w, minlength=len(target))
            goal = np.where(have > 0, target, 0.0)
            goal = goal / goal.sum()
            w = w * np.divide(goal, have, out=np.zeros_like(have), where=have > 0)[axis]
    return w


def solve_scale(tokens: np.ndarray, rate: np.ndarray, budget: float) -> float:
    """The ``scale`` for which ``sum(tokens * min(1, scale * rate)) == budget``."""
    order = np.argsort(-rate, kind="stable")
    t, r = tokens[order], rate[order]
    held = np.concatenate([[0.0], np.cumsum(t)[:-1]])
    free = np.cumsum((t * r)[::-1])[::-1]
    for h, f, top in zip(held, free, r):
        if f > 0 and (budget - h) / f * top <= 1:
            return float((budget - h) / f)
    return float("inf")


def cell_rates(cells: list[tuple], targets: list[Mapping[str, float]], budget_share: float,
               rounds: int = ROUNDS) -> list[tuple[str, str, str, float, float]]:
    """``(source, lang, topic, probability, weight)`` of every cell."""
    live = [c for c in cells if c[3] > 0]
    if not live:
        return [(*c[:3], 1.0, 1.0) for c in cells]
    tokens = np.array([c[3] for c in live], np.float64)
    names = [list(t) for t in targets]
    axes = [np.array([n.index(c[k]) for c in live]) for k, n in enumerate(names)]
    share = rake(tokens, axes, [np.array(list(t.values()), np.float64) for t in targets], rounds)
    rate = share / (tokens / tokens.sum())
    scale = solve_scale(tokens, rate, budget_share * tokens.sum())
    out = [(*c[:3], 1.0, 1.0) for c in cells if c[3] <= 0]
    for c, r in zip(live, rate):
        r = float(r)
        p = min(1.0, scale * r)
        out.append((*c[:3], p, scale * r / p if p > 0 and np.isfinite(scale) else 1.0))
    return out


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        lang_col: str = "lang", topic: Column | None = None, tokens: Column | None = None,
        source_targets: Mapping[str, float] = SOURCE_TARGETS, lang_targets: Mapping[str, float] = LANG_TARGETS,
        topic_targets: Mapping[str, float] = TOPIC_TARGETS, budget_share: float = BUDGET_SHARE,
        rounds: int = ROUNDS, seed: str = SEED, carry: bool = False) -> DataFrame:
    """``doc_id, source, lang, topic, tokens, probability, weight, sampled`` for
    every row; with ``carry`` the rows of ``docs`` that are sampled, unchanged."""
    text = F.col(text_col)
    draw = (F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
                                     .cast("binary")), 1, _DRAW_BITS // 4), 16, 10).cast("double") / float(1 << _DRAW_BITS))
    own = unused(docs, "_mix_")
    marks = {
        own + "source": named(F.col(source_col), source_targets), own + "lang": named(F.col(lang_col), lang_targets),
        own + "topic": named(topic if topic is not None else topic_of(text), topic_targets),
        own + "tokens": tokens if tokens is not None else token_weight(text), own + "draw": draw,
    }
    axes = [own + "source", own + "lang", own + "topic"]
    topic_targets = topic_targets if OTHER in topic_targets else {**topic_targets, OTHER: 0.0}
    source_targets = source_targets if OTHER in source_targets else {**source_targets, OTHER: 0.0}
    lang_targets = lang_targets if OTHER in lang_targets else {**lang_targets, OTHER: 0.0}
    marked = docs.withColumns(marks)
    # at most len(source_targets) * len(lang_targets) * len(topic_targets) rows
    cells = [tuple(r) for r in marked.groupBy(*axes).agg(F.sum(own + "tokens")).collect()]
    cells = sorted((a, b, c, int(t or 0)) for a, b, c, t in cells)
    rates = cell_rates(cells, [source_targets, lang_targets, topic_targets], budget_share, rounds)
    rates = docs.sparkSession.createDataFrame(
        rates, f"{own}source string, {own}lang string, {own}topic string, {own}p double, {own}w double")
    drawn = marked.join(F.broadcast(rates), axes, "left").withColumns({
        own + "p": F.coalesce(own + "p", F.lit(1.0)), own + "w": F.coalesce(own + "w", F.lit(1.0))})
    sampled = F.col(own + "draw") < F.col(own + "p")
    if carry:
        return drawn.where(sampled).select(*[F.col(f"`{c}`") for c in docs.columns])
    return drawn.select(F.col(id_col).cast("long").alias("doc_id"), F.col(own + "source").alias("source"),
                        F.col(own + "lang").alias("lang"), F.col(own + "topic").alias("topic"),
                        F.col(own + "tokens").alias("tokens"), F.round(own + "p", 9).alias("probability"),
                        F.round(own + "w", 9).alias("weight"), sampled.alias("sampled"))


def mixing_sql(docs: str = "documents") -> str:
    """DuckDB twin of :func:`mix` with the default parameters."""
    def category(col: str, targets: Mapping[str, float]) -> str:
        keys = ", ".join(f"'{k}'" for k in targets if k != OTHER)
        return f"CASE WHEN {col} IN ({keys}) THEN {col} ELSE '{OTHER}' END"

    def values(name: str, targets: Mapping[str, float]) -> str:
        rows = ", ".join(f"('{k}', CAST({v!r} AS DOUBLE))" for k, v in targets.items())
        return f"{name}(k, goal) AS (VALUES {rows})"

    ctes = [
        values("goal_source", SOURCE_TARGETS), values("goal_lang", LANG_TARGETS),
        values("goal_topic", {**TOPIC_TARGETS, OTHER: 0.0}),
        f"""marked AS MATERIALIZED (SELECT doc_id, {category('source', SOURCE_TARGETS)} AS source,
  {category('lang', LANG_TARGETS)} AS lang,
  CASE WHEN contains(coalesce(text, ''), 'License') THEN 'legal' WHEN contains(coalesce(text, ''), ' | ') THEN 'tabular'
       WHEN contains(coalesce(text, ''), 'http') OR contains(coalesce(text, ''), '@') THEN 'web' ELSE 'prose' END AS topic,
  CAST(ceil(strlen(coalesce(text, '')) / {BYTES_PER_TOKEN}.0) AS BIGINT) AS tokens,
  CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, {_DRAW_BITS // 4}) AS BIGINT) AS DOUBLE)
    / {1 << _DRAW_BITS}.0 AS draw FROM {docs})""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS tokens FROM marked GROUP BY ALL)",
        "live AS (SELECT * FROM cells WHERE tokens > 0)",
        "w0 AS MATERIALIZED (SELECT *, tokens / sum(tokens) OVER () AS w FROM live)",
    ]
    for axis in ("source", "lang", "topic"):
        ctes.append(f"""g_{axis} AS MATERIALIZED (SELECT k, goal / sum(goal) OVER () AS goal FROM goal_{axis}
  WHERE k IN (SELECT {axis} FROM live))""")
    step = 0
    for _ in range(ROUNDS):
        for axis in ("source", "lang", "topic"):
            ctes.append(f"""w{step + 1} AS MATERIALIZED (SELECT c.source, c.lang, c.topic, c.tokens,
  w * g.goal / sum(w) OVER (PARTITION BY c.{axis}) AS w FROM w{step} c JOIN g_{axis} g ON g.k = c.{axis})""")
            step += 1
    ctes += [
        f"rated AS (SELECT *, w / (tokens / sum(tokens) OVER ()) AS rate, {BUDGET_SHARE} * sum(tokens) OVER () AS budget FROM w{step})",
        """ranked AS (SELECT *, row_number() OVER o AS k,
  sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING) - tokens AS held,
  sum(tokens * rate) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM rated WINDOW o AS (ORDER BY rate DESC, source, lang, topic))""",
        """scaled AS (SELECT arg_min((budget - held) / free, k) AS scale FROM ranked
  WHERE free > 0 AND (budget - held) / free * rate <= 1)""",
        """probs AS (SELECT source, lang, topic, least(1.0, scale * rate) AS p,
  CASE WHEN scale * rate > 0 THEN scale * rate / least(1.0, scale * rate) ELSE 1.0 END AS wt FROM ranked, scaled)""",
    ]
    return "WITH " + ",\n".join(ctes) + """
SELECT doc_id, m.source, m.lang, m.topic, tokens, round(coalesce(p, 1.0), 9) AS probability,
       round(coalesce(wt, 1.0), 9) AS weight, draw < coalesce(p, 1.0) AS sampled
FROM marked m LEFT JOIN probs USING (source, lang, topic)"""
