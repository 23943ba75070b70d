"""Highlighted snippets. Made for the rows that are shown, after the ranking has cut the rest.

Spark has no replacement by a function, so this is an Arrow-batched UDF.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siftline.config import DEFAULTS
from siftline.functions.fold import stem
from siftline.functions.text import STOP_WORDS

# What counts as a word, what is dropped of it before it is stemmed, and the marks around words and cuts.
_WORD = re.compile(r"\b[a-zA-Z0-9_-]+\b")
_OTHER = re.compile(r"[^a-zA-Z0-9]")
_STOP = frozenset(STOP_WORDS)


#: Stems met before; forgotten beyond so many.
_KNOWN: dict[str, str] = {}
_REMEMBERED = 50_000


def _stem_of(word: str) -> str:
    if word not in _KNOWN:
        if len(_KNOWN) > _REMEMBERED:
            _KNOWN.clear()
        _KNOWN[word] = stem(_OTHER.sub("", word.lower()))
    return _KNOWN[word]


def highlight(text: str | None, terms: list[str]) -> str:
    """``text`` with <mark> around each word whose stem is that of a term of two letters or more, or which is
    a term but for capitals. Markup in the text isn't escaped."""
    if not text or not terms:
        return text or ""
    stemmed = {stem(t.lower()) for t in terms if len(t) > 1}
    plain = {t.lower() for t in terms}
    mark = lambda m: f"<mark>{m[0]}</mark>" if _stem_of(m[0]) in stemmed or m[0].lower() in plain else m[0]
    return _WORD.sub(mark, text)


def snippet(text: str | None, terms: list[str], length: int = DEFAULTS.snippet_length, words: int = DEFAULTS.snippet_words, step: int = DEFAULTS.snippet_step) -> str:
    """The first window of ``words`` words, of those that begin at every ``step``-th word, that holds most terms."""
    if not text:
        return ""
    clean = re.sub(r"\s+", " ", text).strip()
    if len(clean) <= length:
        return highlight(clean, terms)
    wanted = {stem(t.lower()) for t in terms if t.lower() not in _STOP}
    all_words = clean.split(" ")
    size = min(words, len(all_words))
    hit = [_stem_of(w) in wanted for w in all_words]
    before = [0]
    for h in hit:
        before.append(before[-1] + h)
    starts = range(0, max(1, len(all_words) - size + 1), step)
    best = max(starts, key=lambda i: (before[i + size] - before[i], -i))
    shown = highlight(" ".join(all_words[best : best + size]), terms)
    return ("... " if best else "") + shown + (" ..." if best + size < len(all_words) else "")


def snippets(text: Column, terms: Column, **sizes: int) -> Column:
    """The snippet of each row's text for its array of terms."""

    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([snippet(t, [] if w is None else list(w), **sizes) for t, w in zip(texts, lists)])

    return F.pandas_udf(run, "string")(text, terms)


def highlights(text: Column, terms: Column) -> Column:
    def run(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([highlight(t, [] if w is None else list(w)) for t, w in zip(texts, lists)])

    return F.pandas_udf(run, "string")(text, terms)
