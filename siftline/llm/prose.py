"""What same-language prose looks like, word by word: used to tell sentences from keywords and furniture.

The model is the words, word pairs and word triples that at least HOLDERS graded samples of prose hold. They
are counted over all samples, on the executors. The model grows with what samples have in common; it is
broadcast.

Languages without samples are told by their short words, which the samples don't know, in pieces of
text that have the shape of sentences; there the shape decides: see ``foreign``.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples that must hold a pair or triple, so that names don't make any.
HOLDERS = 2
#: A sentence is real if it has so many words, such a share of its pairs is known, and so many triples.
#: Long sentences name more things that no sample has: of them fewer pairs must be known, and more triples.
LEAST_WORDS, PAIR_SHARE, LEAST_TRIPLES = 4, 0.25, 1
LONG, LONG_PAIR_SHARE, LONG_TRIPLES = 12, 0.15, 2
#: Besides, so many different content words must stand in its known pairs: keywords strung on articles and
#: conjunctions have known pairs and triples too, but not of content words.
LEAST_CONTENT = 2
#: Function words are those that most samples of a language hold: such a share of its words at most, so
#: many at most, each in such a share of the samples at least. All other known words are content words.
FUNCTION_SHARE, MOST_FUNCTION, FUNCTION_HOLDERS = 0.03, 100, 0.25

#: The shape of a sentence: so many words, of which such shares are short, up to so many letters; a sentence
#: is none if more than such a share of its word pairs stands so often on the page.
SHAPE_WORDS, SHORT, LEAST_SHORT, MOST_SHORT, REPEATED_SHARE, REPEATED = 6, 3, 0.12, 0.75, 0.5, 4
#: A page is in a language without samples if the samples know less than this share of the short words of its
#: sentences, and these have such a share of its words.
KNOWN_SHORT, SENTENCE_WORDS = 0.65, 0.4

#: Words, and the marks at which a sentence or an item of a list ends.
TOKEN, MARKS = re.compile(r"[^\W\d_]+|[.!?;|/*\n\r]"), ".!?;|/*\n\r"
_END = re.compile(r"[.!?;|/*\n\r]")
_BITS = 31
#: What samples hold: themselves, words of a language, pairs and triples of words, in which _EDGE is the edge of a sentence.
_SAMPLE, _WORD_OF, _PAIR, _TRIPLE = 0, 1, 2, 3
_EDGE = "^"


def plain(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def _held(lang: str, text: str) -> set[tuple[int, str, str]]:
    """Kind, language and words of all that a sample holds. Pairs and triples are those of any language."""
    own = [[_EDGE, *s, _EDGE] for s in _split(TOKEN.findall(plain(text))) if s]
    out = {(_SAMPLE, lang, "")} | {(_WORD_OF, lang, w) for s in own for w in s[1:-1]}
    out |= {(_PAIR, "", " ".join(p)) for s in own for p in zip(s, s[1:])}
    return out | {(_TRIPLE, "", " ".join(t)) for s in own for t in zip(s, s[1:], s[2:])}


def train(rows: list[tuple[str, str]]) -> dict:
    """The model of (language, text) rows, as plain arrays and dicts."""
    counts = Counter(x for lang, text in rows for x in _held(lang, text))
    return _model((*x, n) for x, n in counts.items() if n >= HOLDERS or x[0] == _SAMPLE)


def _model(held: Iterable[tuple[int, str, str, int]]) -> dict:
    """The model of what at least HOLDERS samples hold, and of the number of samples of each language: rows (kind,
    language, words, samples). A word is known if so many samples of one language hold it. Words have 31 bits; a
    triple is the place of its first two words among the pairs, and its last word."""
    rows: list[list[tuple]] = [[], [], [], []]
    for kind, lang, key, n in held:
        rows[kind].append((lang, key, n))
    samples = {lang: n for lang, _, n in rows[_SAMPLE]}
    holders: dict[str, list[tuple[int, str]]] = {lang: [] for lang in sorted(samples)}
    for lang, w, n in rows[_WORD_OF]:
        holders[lang].append((-n, w))
    words = {w: k for k, w in enumerate(sorted({w for _, w, _ in rows[_WORD_OF]}), 2)}  # 0: unknown
    number = words | {_EDGE: 1}
    numbered = lambda kind: np.array([ids for _, key, _ in rows[kind] if all(ids := [number.get(w, 0) for w in key.split(" ")])], np.int64).reshape(-1, kind)
    pair, triple = numbered(_PAIR), numbered(_TRIPLE)
    pair = np.sort(pair[:, 0] << _BITS | pair[:, 1])
    triple = np.sort(np.searchsorted(pair, triple[:, 0] << _BITS | triple[:, 1]) << _BITS | triple[:, 2])
    langs = list(holders)
    known = np.zeros((len(langs), len(words) + 2), np.int32)
    content = np.ones(len(words) + 2, bool)
    content[:2] = False
    for i, lang in enumerate(langs):
        own = sorted(holders[lang])
        known[i, [words[w] for _, w in own]] = 1
        most = min(MOST_FUNCTION, int(FUNCTION_SHARE * len(own)))
        content[[words[w] for n, w in own[:most] if -n >= FUNCTION_HOLDERS * samples[lang]]] = False
    return {"words": words, "pairs": pair, "triples": triple, "langs": langs, "known": known, "content": content}


def _split(tokens: list[str]) -> list[list[str]]:
    out: list[list[str]] = [[]]
    for t in tokens:
        if _END.match(t):
            out.append([])
        else:
            out[-1].append(t)
    return out


def load(samples: DataFrame) -> dict:
    """The model of all rows of ``samples`` (lang, text), counted on the executors; what HOLDERS samples have in
    common goes to the driver. Rows with a null lang or text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                counts = Counter(x for lang, text in zip(*(c.to_pylist() for c in some.columns)) for x in _held(lang, text))
                columns = [*zip(*counts), counts.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int64()))], ["kind", "lang", "words", "n"])

    rows = samples.select("lang", "text").where("lang is not null and text is not null")
    held = rows.mapInArrow(run, "kind int, lang string, words string, n long").groupBy("kind", "lang", "words").agg(F.sum("n").alias("n"))
    return _model(tuple(r) for r in held.where((F.col("n") >= HOLDERS) | (F.col("kind") == _SAMPLE)).collect())


#: Samples counted together by a task.
TOGETHER = 500


def _places(sorted_keys: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key stands among the sorted ones; -1 if it doesn't."""
    if not len(sorted_keys):
        return np.full(len(keys), -1, np.int64)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == keys, at, -1)


#: Kinds of word pairs: known with a content word, known without, unknown with a function word, of two known
#: words, others. The ends of a sentence count as words.
KINDS = 5


class Sentences:
    """The sentences of some texts: their owner (the place of the text), words, known pairs and
    triples, different content words in known pairs, pairs of each kind, and words known in each language."""

    def __init__(self, texts: list[str | None], model: dict):
        if "numbers" not in model:  # of words, and of marks
            model["numbers"] = model["words"] | dict.fromkeys(MARKS, -1)
        tokens = [TOKEN.findall(plain(t)) if t else [] for t in texts]
        self.tokens = tokens
        count = np.fromiter(map(len, tokens), np.int64, len(tokens))
        owner = np.repeat(np.arange(len(tokens)), count)
        ids = np.fromiter(map(model["numbers"].get, chain.from_iterable(tokens), repeat(0)), np.int64, int(count.sum()))
        end = ids == -1
        new_text = np.r_[True, owner[1:] != owner[:-1]] if len(ids) else np.empty(0, bool)
        number = np.cumsum(np.r_[False, end[:-1]] | new_text) if len(ids) else np.empty(0, np.int64)
        word = ~end
        ids, owner, number = ids[word], owner[word], number[word]
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(ids) else np.empty(0, np.int64)
        self.size = np.diff(np.r_[starts, len(ids)])
        self.owner = owner[starts]
        # with an edge before and after each sentence
        padded = np.full(len(ids) + 2 * len(starts), 1, np.int64)
        place = np.arange(len(ids)) + 2 * np.repeat(np.arange(len(starts)), self.size) + 1
        padded[place] = ids
        first = starts + 2 * np.arange(len(starts))
        if not len(starts):
            self.pairs = self.triples = self.content = self.size
            self.kinds = np.zeros((0, KINDS), np.int64)
            self.known = np.zeros((len(model["langs"]), 0), np.int64)
            return
        a, b = padded[:-1], padded[1:]
        place = _places(model["pairs"], a << _BITS | b)
        pair = np.r_[(place >= 0).astype(np.int64), 0]
        pair[np.r_[first[1:], len(padded)] - 1] = 0  # from one sentence to the next
        named = model["content"]
        function = (padded > 1) & ~named[padded]
        kind = np.where(
            pair[:-1] > 0, np.where(named[a] | named[b], 0, 1), np.where(function[:-1] | function[1:], 2, np.where((a > 1) & (b > 1), 3, 4))
        )
        sentence = np.repeat(np.arange(len(starts)), self.size + 2)
        within = sentence[:-1] == sentence[1:]
        self.kinds = np.bincount(sentence[:-1][within] * KINDS + kind[within], minlength=len(starts) * KINDS).reshape(-1, KINDS)
        at = np.flatnonzero(pair)
        of = sentence[at]
        both = np.r_[of << _BITS | padded[at], of << _BITS | padded[at + 1]]
        different = np.unique(both[model["content"][both & (1 << _BITS) - 1]])
        self.content = np.bincount(different >> _BITS, minlength=len(starts))
        triple = np.r_[(_places(model["triples"], place[:-1] << _BITS | padded[2:]) >= 0).astype(np.int64), 0, 0]
        for back in (1, 2):
            triple[np.r_[first[1:], len(padded)] - back] = 0
        self.pairs, self.triples = np.add.reduceat(pair, first), np.add.reduceat(triple, first)
        self.known = np.stack([np.add.reduceat(k[ids], starts) for k in model["known"]]) if len(model["langs"]) else np.zeros((0, len(starts)), np.int64)

    def real(self) -> np.ndarray:
        """Which sentences are real ones."""
        named = self.content >= LEAST_CONTENT
        enough = (self.size >= LEAST_WORDS) & (self.pairs >= PAIR_SHARE * self.size) & (self.triples >= LEAST_TRIPLES)
        long = (self.size >= LONG) & (self.pairs >= LONG_PAIR_SHARE * self.size) & (self.triples >= LONG_TRIPLES)
        return named & (enough | long)


_STOP = re.compile(r"[.!?\u2026\u3002\uff01\uff1f]+")
_WORD = re.compile(r"[\u3040-\u30ff\u3400-\u9fff]|[^\W\d_\u3040-\u30ff\u3400-\u9fff]+")


def _shaped(words: list[str]) -> bool:
    """Words that begin with a capital, or in a script without them, and are short as often as in prose. In scripts
    without spaces each sign is a word."""
    if len(words) < SHAPE_WORDS or words[0][0].islower():
        return False
    signs = sum("\u3040" <= w <= "\u9fff" for w in words)
    return 2 * signs > len(words) or LEAST_SHORT <= sum(len(w) <= SHORT for w in words) / len(words) <= MOST_SHORT


def shaped(line: str) -> list[list[str]]:
    """The words of each piece of a line that has the shape of a sentence and ends with a mark."""
    return [w for w in map(_WORD.findall, _STOP.split(line)[:-1]) if _shaped(w)]


def foreign(text: str, model: dict) -> list[tuple[int, int]] | None:
    """For each line of a page in a language without samples its sentences and their words; None for a page that
    isn't in such a language, or is mostly no sentences, or if there are no samples.

    A sentence is a piece of the shape of one of which most word pairs aren't repeated on the page, as
    those of keywords are.
    """
    lines = [shaped(line) for line in text.split("\n")]
    pieces = [w for own in lines for w in own]
    if not pieces:
        return None
    low = [[x.lower() for x in w] for w in pieces]
    short = [x for w in low for x in w if len(x) <= SHORT]
    get = model["words"].get
    ids = [k for x in short if (k := get(x))]
    if not model["langs"] or short and model["known"][:, ids].sum(axis=1).max(initial=0) >= KNOWN_SHORT * len(short):
        return None
    pairs = Counter(p for w in low for p in zip(w, w[1:]))
    out, k = [], 0
    for own in lines:
        n = words = 0
        for w in own:
            held = list(zip(low[k], low[k][1:]))
            k += 1
            if sum(pairs[p] >= REPEATED for p in held) <= REPEATED_SHARE * len(held):
                n, words = n + 1, words + len(w)
        out.append((n, words))
    return out if sum(w for _, w in out) >= SENTENCE_WORDS * len(_WORD.findall(text)) else None


def may_be_foreign(text: str | None, n_real: int) -> bool:
    """Whether ``foreign`` is worth asking: few of the sentences of the page are real ones by the samples."""
    return bool(text) and n_real < max(3, (text.count(". ") + text.count(".\n") + text.count("\u3002")) / 2)
