"""Quality rules, line first: every line is judged by punctuation, navigation and
boilerplate rules, failing lines are removed, and a document that loses too
much of its text is rejected.

A line with a word fails when any of these hold:

* symbols: three or more of the characters in ``SYMBOLS``, and at least one for
  every two words;
* punctuation: fewer than ``SHORT_WORDS`` words and no closing punctuation;
* navigation: at least three separators (``|``, ``>``, ``»``, ``·``, ``•`` as
  words) and one for every four words;
* boilerplate: at most ``PHRASE_WORDS`` words and one of the fixed phrases;
* shouting: twenty or more letters of which seven in ten are capitals.

A document is kept when its base checks pass and the lines that fail hold at
most half of its words.  One pass, no shuffle; the SQL twin is
:func:`line_quality_sql`.

Defined results: words are runs of bytes other than 0x20, 0x09-0x0D; a null,
empty or blank text has no word, fails the base checks and is not kept;
repeated rows get equal results; a null id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_SYMBOLS = "#*$%&|<>"
SYMBOLS = "#*$%&|<>~^=+_@{}\\"
CLOSING = ".!?…:;\"'”’»)]"
SEPARATORS = ("|", ">", "»", "·", "•")
SHORT_WORDS = 8
PHRASE_WORDS = 40
MIN_WORDS = 50
# FIXED VALUES: phrases that mark a boilerplate line (lower case).
PHRASES = (
    "licensed under", "all rights reserved", "copyright ©", "©", "terms of use", "terms of service", "privacy policy",
    "cookie", "javascript", "subscribe to", "newsletter", "sign in", "log in", "sign up", "click here", "read more",
    "lorem ipsum", "skip to content", "powered by", "spdx-license-identifier",
)
FIELDS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bad_lines", "n_lost_words")

_SPACE = " \t\n\x0b\x0c\r"
_WORD = regex.compile(r"[^\x20\x09-\x0D]+")
_LETTER = regex.compile(r"\p{L}")
_CAPITAL = regex.compile(r"\p{Lu}")


def count_of(text: str, characters: str) -> int:
    return sum(map(text.count, characters))


def line_fails(line: str, n_words: int) -> bool:
    """Whether a line with ``n_words`` (> 0) words breaks a rule."""
    symbols = count_of(line, SYMBOLS)
    if symbols >= 3 and 2 * symbols >= n_words:
        return True
    if n_words < SHORT_WORDS and line.rstrip(_SPACE)[-1] not in CLOSING:
        return True
    separators = sum(map(_WORD.findall(line).count, SEPARATORS)) if any(s in line for s in SEPARATORS) else 0
    if separators >= 3 and 4 * separators >= n_words:
        return True
    if n_words <= PHRASE_WORDS:
        low = line.lower()
        if any(p in low for p in PHRASES):
            return True
    capitals = len(_CAPITAL.findall(line))
    return capitals >= 14 and (letters := len(_LETTER.findall(line))) >= 20 and 10 * capitals >= 7 * letters


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more, the first included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    window = (code[:-2] * len(number) + code[1:-1]) * len(number) + code[2:] if len(number) < 2_000_000 else None
    if window is None:
        _, inner = np.unique(code[:-2] * len(number) + code[1:-1], return_inverse=True)
        window = inner.astype(np.int64) * len(number) + code[2:]
    _, place, count = np.unique(window, return_inverse=True, return_counts=True)
    again = count[place] >= 2
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift:n - 2 + shift] |= again
    return int(covered.sum())


def measure(text: str) -> tuple[int, ...]:
    """All of ``FIELDS`` but the id."""
    raw = text.encode("utf-8")
    words = raw.split()
    spaces = raw.count(b" ") + sum(raw.count(bytes([b])) for b in range(9, 14))
    seen: set[str] = set()
    lines = bad = lost = dup = 0
    for line in text.split("\n"):
        n = len(line.encode("utf-8").split()) if line else 0
        if n == 0:
            continue
        lines += 1
        if line in seen:
            dup += 1
        seen.add(line)
        if line_fails(line, n):
            bad += 1
            lost += n
    return len(words), len(text) - spaces, count_of(text, BASE_SYMBOLS), dup, repeated_words(words), lines, bad, lost


def clean_text(text: str | None) -> str:
    """The text without its failing lines; blank lines stay."""
    return "\n".join(line for line in (text or "").split("\n")
                     if not (n := len(line.encode("utf-8").split())) or not line_fails(line, n))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(f, pa.int64()) for f in FIELDS])
    for batch in batches:
        rows = [measure(t or "") for t in batch.column("text").to_pylist()]
        columns = list(zip(*rows)) if rows else [()] * (len(FIELDS) - 1)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns]], schema=schema)


def line_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and verdict of every row of ``docs``."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = source.mapInArrow(_measured, ", ".join(f"{f} long" for f in FIELDS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                        failed.alias("base_failed"), (~failed & (2 * F.col("n_lost_words") <= F.col("n_words"))).alias("kept"),
                        "n_lines", "n_bad_lines", "n_lost_words")


def _cleaned(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([clean_text(t) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), texts)
    return run


def clean_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with failing lines removed from every text, columns unchanged."""
    return docs.mapInArrow(_cleaned(docs.columns.index(text_col)), docs.schema)


def line_quality_sql(docs: str = "documents") -> str:
    """DuckDB twin of :func:`line_quality`."""
    def n_of(col: str, characters: str) -> str:
        return f"length({col}) - length(translate({col}, '{characters.replace(chr(39), chr(39) * 2)}', ''))"

    def word_list(col: str) -> str:
        return f"regexp_extract_all({col}, '[^\\x20\\x09-\\x0D]+')"

    phrases = " OR ".join(f"contains(lower(l), '{p}')" for p in PHRASES)
    seps = ", ".join(f"'{s}'" for s in SEPARATORS)
    closing = ", ".join("'" + c.replace("'", "''") + "'" for c in CLOSING)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM {docs}),
w AS (SELECT r, doc_id, t, {word_list('t')} AS ws FROM d),
ls AS (SELECT r, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
lw AS (SELECT r, l, i, {word_list('l')} AS ws FROM ls),
lf AS (SELECT r, l, i, len(ws) AS n,
  ({n_of('l', SYMBOLS)} >= 3 AND 2 * ({n_of('l', SYMBOLS)}) >= len(ws))
  OR (len(ws) < {SHORT_WORDS} AND right(ws[-1], 1) NOT IN ({closing}))
  OR (len(list_filter(ws, lambda x: x IN ({seps}))) >= 3 AND 4 * len(list_filter(ws, lambda x: x IN ({seps}))) >= len(ws))
  OR (len(ws) <= {PHRASE_WORDS} AND ({phrases}))
  OR (length(regexp_replace(l, '\\P{{L}}', '', 'g')) >= 20
      AND 10 * length(regexp_replace(l, '\\P{{Lu}}', '', 'g')) >= 7 * length(regexp_replace(l, '\\P{{L}}', '', 'g'))) AS bad,
  row_number() OVER (PARTITION BY r, l ORDER BY i) AS nth
  FROM lw WHERE len(ws) > 0),
la AS (SELECT r, count(*) AS n_lines, count(*) FILTER (nth > 1) AS n_dup, count(*) FILTER (bad) AS n_bad,
  coalesce(sum(n) FILTER (bad), 0) AS n_lost FROM lf GROUP BY r),
wi AS (SELECT r, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT r, i, x, lead(x, 1) OVER o AS y, lead(x, 2) OVER o AS z FROM wi WINDOW o AS (PARTITION BY r ORDER BY i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS c FROM tri WHERE z IS NOT NULL) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, i + s AS j FROM again, (VALUES (0), (1), (2)) v(s)) GROUP BY r),
m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST({n_of('t', BASE_SYMBOLS)} AS BIGINT) AS n_symbols, CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
  CAST(coalesce(n_bad, 0) AS BIGINT) AS n_bad_lines, CAST(coalesce(n_lost, 0) AS BIGINT) AS n_lost_words
  FROM w LEFT JOIN la USING (r) LEFT JOIN rep USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_lost_words <= n_words AS kept,
  n_lines, n_bad_lines, n_lost_words
FROM m"""
