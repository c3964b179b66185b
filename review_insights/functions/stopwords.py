"""English stop words for keyword extraction.

The words are a parameter: a plain text file, one or more words per line, that
ships with the package and may be replaced by the caller's own.  The shipped
list is the English list commonly used with TF-IDF vectorisers; its
contractions carry no apostrophe (``cant``, ``couldnt``, ``hasnt``), which is
the form the keyword tokeniser produces after deleting punctuation.

Reading the list needs neither a JVM nor a session.
"""

from __future__ import annotations

import functools
from importlib import resources


@functools.lru_cache(maxsize=8)
def read_stop_words(path: str | None = None) -> tuple[str, ...]:
    """Words of ``path``, or of the shipped list when no path is given."""
    if path is None:
        text = resources.files("review_insights.resources").joinpath("english_stop_words.txt").read_text("utf-8")
    else:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    return tuple(dict.fromkeys(text.split()))


def english_stop_words() -> tuple[str, ...]:
    return read_stop_words()
