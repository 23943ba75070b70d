"""Problem 8: the reading level of each text.

Smoothed unigram language models (Collins-Thompson and Callan 2004): one for each level of each
language, trained on graded samples. Every sentence goes to the level of highest posterior: the prior
of the level, its share of the language's samples, times the likelihood of the sentence's words. Words
that a level's samples lack have smoothed counts; words that the language's samples lack, or one of
them alone has, are one word of the model like others. The text has the level of most of its
sentences, as it may be written in several. The language is the one whose models know most of the
text's words, since stated languages are often wrong.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.storage import table, without_copies

#: Graded samples that the models are trained on at most; a documented bound, taken by least id.
SAMPLES = 20_000
#: Added to the count of each word at each level.
SMOOTHING = 0.5
#: Samples that must hold a word; rarer ones are mostly names, which say nothing of a level.
HOLDERS = 2
#: Known words that a sentence must have to be judged, as long as any sentence of the text has so many.
KNOWN = 3

WORD, SENTENCE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?\n\r]+")


def plain(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


def lix(words: int, sentences: int, long_words: int) -> float:
    """Bjoernsson's readability index: words a sentence, and words of over six letters in a hundred."""
    return words / max(1, sentences) + 100 * long_words / max(1, words)


def train(samples: list[tuple[str, int, str]]) -> dict:
    """The models of (language, level, text) rows; plain arrays, bounded by the samples' words."""
    counts: dict[str, dict[int, Counter]] = defaultdict(lambda: defaultdict(Counter))
    holders: dict[str, Counter] = defaultdict(Counter)
    easy: dict[int, list[float]] = defaultdict(list)
    for lang, level, text in samples:
        words = WORD.findall(plain(text))
        counts[lang][level].update(words)
        holders[lang].update(set(words))
        sentences = [s for s in SENTENCE.split(text) if s.strip()]
        easy[level].append(lix(len(words), len(sentences), sum(len(w) > 6 for w in words)))
    langs, levels = sorted(counts), sorted(easy)
    vocabulary: dict[str, int] = {}
    for lang in langs:
        for w, n in holders[lang].items():
            if n >= HOLDERS:
                vocabulary.setdefault(w, len(vocabulary))
    samples_of = Counter((lang, level) for lang, level, _ in samples)
    known = np.zeros((len(langs), len(vocabulary) + 1), bool)
    prior = np.zeros((len(langs), len(levels)))
    likely = np.zeros((len(langs), len(vocabulary) + 1, len(levels)))
    for i, lang in enumerate(langs):
        own = [w for w, n in holders[lang].items() if n >= HOLDERS]
        at = [vocabulary[w] for w in own]
        known[i, at] = True
        for j, level in enumerate(levels):
            c = np.array([counts[lang][level][w] for w in own], float) + SMOOTHING
            unseen = sum(counts[lang][level].values()) - c.sum() + SMOOTHING * (len(c) + 1)
            likely[i, :, j] = np.log(unseen / (c.sum() + unseen))  # of any other word
            likely[i, at, j] = np.log(c / (c.sum() + unseen))
            prior[i, j] = np.log((samples_of[lang, level] + SMOOTHING) / sum(samples_of[lang, v] + SMOOTHING for v in levels))
    typical = [sum(easy[v]) / len(easy[v]) for v in levels]
    return {"langs": langs, "levels": levels, "words": vocabulary, "known": known, "likely": likely, "prior": prior, "lix": typical}


def judge(texts: list[str | None], model: dict) -> list[tuple[str | None, int | None, float | None, int]]:
    """For each text its language, its level, the share of judged sentences at that level, and its words
    between white space. Nothing but the number of words for texts without letters."""
    get, unknown = model["words"].get, len(model["words"])
    sentence_words, owner, n_words = [], [], []
    for k, text in enumerate(texts):
        n_words.append(len(text.split()) if text else 0)
        if text:
            for s in SENTENCE.split(plain(text)):
                if own := WORD.findall(s):
                    sentence_words.append(own)
                    owner.append(k)
    out: list = [(None, None, None, n) for n in n_words]
    if not sentence_words or not model["langs"]:
        return out
    size = np.fromiter(map(len, sentence_words), np.int64, len(sentence_words))
    ids = np.fromiter((get(w, unknown) for s in sentence_words for w in s), np.int64, int(size.sum()))
    owner = np.array(owner)
    starts = np.cumsum(size) - size
    texts_here, first = np.unique(owner, return_index=True)
    known = np.stack([np.add.reduceat(model["known"][i][ids].astype(np.int64), starts) for i in range(len(model["langs"]))])
    lang_of = np.add.reduceat(known, first, axis=1).argmax(axis=0)
    lang = np.repeat(lang_of, np.diff(np.r_[first, len(owner)]))
    scores = np.add.reduceat(model["likely"][np.repeat(lang, size), ids], starts, axis=0)
    scores += model["prior"][lang]
    level, sure = scores.argmax(axis=1), known[lang, np.arange(len(lang))]
    for t, (a, b) in enumerate(zip(first, np.r_[first[1:], len(owner)])):
        k = int(texts_here[t])
        least = min(KNOWN, int(sure[a:b].max()))
        if least:
            votes = np.bincount(level[a:b][sure[a:b] >= least], minlength=len(model["levels"]))
            total = scores[a:b].sum(axis=0)
            best = max(range(len(votes)), key=lambda v: (votes[v], total[v], -v))
            out[k] = (model["langs"][lang_of[t]], model["levels"][best], float(votes[best] / votes.sum()), n_words[k])
        else:  # no model knows a word: the level whose samples are as easy by formula
            own = lix(int(size[a:b].sum()), b - a, sum(len(w) > 6 for s in sentence_words[a:b] for w in s))
            near = min(range(len(model["lix"])), key=lambda v: (abs(model["lix"][v] - own), v))
            out[k] = (None, model["levels"][near], None, n_words[k])
    return out


#: Texts judged together.
TOGETHER = 500


def reading_levels(df: DataFrame, id_col: str, text_col: str, samples: DataFrame, *, max_samples: int = SAMPLES) -> DataFrame:
    """(id_col, lang, reading_level, share, n_words): one row per value of ``id_col``.

    ``samples`` has sample_id, lang, reading_level and text; rows with a null in one of the last three
    are left out, and at most ``max_samples`` by least sample_id are used. share is the share of the
    judged sentences that have the level, n_words the number of runs between white space. A text of
    which no model knows a word has the level whose samples are as easy by formula, and a null lang
    and share. A text without letters (null, empty, numbers only) has a null level; so has every
    text if there are no samples. Equal votes go to the likelier level of the whole text, then to the
    lower one. Rows delivered twice count once; a null id is a value like others.
    """
    rows = samples.select("sample_id", "lang", "reading_level", "text").where("lang is not null and reading_level is not null and text is not null")
    rows = rows.orderBy("sample_id", "text").limit(max_samples).collect()
    known = df.sparkSession.sparkContext.broadcast(train([(r.lang, r.reading_level, r.text) for r in rows]))
    kind = dict(df.dtypes)[id_col]
    schema = pa.schema([("lang", pa.string()), ("reading_level", pa.int32()), ("share", pa.float64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, TOGETHER):
                some = batch.slice(lo, TOGETHER)
                judged = judge(some.column(1).to_pylist(), known.value)
                columns = [pa.array(c, f.type) for c, f in zip(zip(*judged), schema)]
                yield pa.RecordBatch.from_arrays([some.column(0), *columns], [id_col, *schema.names])

    return without_copies(df.select(id_col, text_col), id_col).mapInArrow(
        run, f"`{id_col}` {kind}, lang string, reading_level int, share double, n_words long"
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, reading_level) of the documents of at least 40 words."""
    return p8_levels(spark, sf_dir).where("n_words >= 40").select("doc_id", "reading_level")


def p8_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, level and its share of the sentences, and words, of every row of documents."""
    return reading_levels(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "reading_samples"))
