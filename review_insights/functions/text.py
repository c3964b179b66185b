"""Column expressions over review text.  All JVM-side; no Python per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode-aware whitespace plus the four information separators U+001C..U+001F,
# which Python's str.strip() also removes but Java's \s does not cover.
_EDGE_WS = r"(?U)^[\s\x{1c}-\x{1f}]+|[\s\x{1c}-\x{1f}]+$"
# Keep ASCII letters and (Unicode) whitespace; every other character is deleted.
_NON_LETTER = r"(?U)[^a-zA-Z\s]"
_WORD = r"([a-z]{2,})"


def strip_unicode(c: Column) -> Column:
    """Trim leading/trailing whitespace the way Python's ``str.strip()`` does."""
    return F.regexp_replace(c, _EDGE_WS, "")


def lower_or_empty(c: Column) -> Column:
    """``lower(c)`` with null mapped to the empty string."""
    return F.lower(F.coalesce(c, F.lit("")))


def contains_kw(lowered: Column, keyword: str) -> Column:
    """Substring keyword test on an already-lowered column (never tokenised).

    ``contains`` is a byte search; ``instr`` would also convert the match offset
    to a character position, which costs several times more per call.
    """
    return lowered.contains(keyword)


def contains_any(lowered: Column, keywords: Iterable[str]) -> Column:
    tests = [contains_kw(lowered, k) for k in keywords]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def keyword_hits(lowered: Column, keywords: Iterable[str]) -> Column:
    """Number of distinct keywords present as substrings (an int column)."""
    total = None
    for k in keywords:
        term = contains_kw(lowered, k).cast("int")
        total = term if total is None else total + term
    return total


def keyword_clean(c: Column) -> Column:
    """Delete everything outside letters/whitespace, then lower-case; null -> ''."""
    return F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), _NON_LETTER, ""))


def word_tokens(cleaned: Column) -> Column:
    """Tokens of two or more letters from a cleaned (lower-case letters only) text."""
    return F.regexp_extract_all(cleaned, F.lit(_WORD), 1)


def with_bigrams(tokens: Column) -> Column:
    """Unigrams followed by adjacent-pair bigrams joined by a space.

    The pairs zip the token list with itself shifted by one; both sides are cut
    to n - 1 elements, so no padding element ever forms a pair.
    """
    m = F.greatest(F.size(tokens) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(tokens, 1, m), F.slice(tokens, 2, m),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(tokens, pairs)
