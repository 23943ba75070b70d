"""Corrections of misspelled queries against the words of the collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftline.config import DEFAULTS
from siftline.functions.text import tokens
from siftline.storage import materialize

#: Edits between a word and its correction, and letters a word must have to be corrected.
DISTANCE, SHORTEST = 2, 3
COMMON_WEIGHT = 5


def vocabulary(frequency: DataFrame, *, common: tuple[str, ...] = DEFAULTS.common_words) -> DataFrame:
    """(term, freq): the terms of the collection, and common words that it doesn't have."""
    spark = frequency.sparkSession
    words = spark.createDataFrame([(w, COMMON_WEIGHT) for w in common], "term string, freq long")
    # read twice, and dear to make
    own = materialize(frequency.select("term", F.col("df").alias("freq")), "term-frequencies")
    return own.unionByName(words.join(own, "term", "left_anti"))


def _cut(length: Column, parts: int, i: Column) -> tuple[Column, Column]:
    """Begin (from 0) and length of the i-th of so many parts of a word, as even as can be."""
    base, longer = F.floor(length / parts).cast("int"), length % parts
    more = F.greatest(F.lit(0), i - (parts - longer))
    return i * base + more, base + F.when(i >= parts - longer, 1).otherwise(0)


def _key(length: Column, i: Column, part: Column) -> Column:
    return F.struct(length.cast("int").alias("length"), i.cast("int").alias("i"), part.alias("part"))


def parts_of(term: Column, distance: int) -> Column:
    """A term cut in distance + 1 parts, each with the length of the term and its number. A word within that many
    edits of the term leaves one of them whole, moved by no more places than edits."""
    n = distance + 1

    def part(i):
        begin, size = _cut(F.length(term), n, i)
        return _key(F.length(term), i, F.substring(term, begin + 1, size))

    return F.transform(F.sequence(F.lit(0), F.lit(distance)), part)


def places_of(word: Column, distance: int) -> Column:
    """What of a word may be a whole part of a term within so many edits: at most (2d + 1)^2 (d + 1) keys, however
    long the word is."""
    n, size = distance + 1, F.length(word)
    none = F.array().cast("array<struct<length: int, i: int, part: string>>")

    def for_part(length, i):
        begin, wide = _cut(length, n, i)
        first, last = F.greatest(F.lit(0), begin - distance), F.least(size - wide, begin + distance)
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda at: _key(length, i, F.substring(word, at + 1, wide)))).otherwise(none)

    lengths = F.sequence(F.greatest(F.lit(1), size - distance), size + distance)
    every = F.flatten(F.transform(lengths, lambda m: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(distance)), lambda i: for_part(m, i)))))
    return F.array_distinct(every)


def near_words(words: DataFrame, vocab: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(word, term, freq, d): the terms of ``vocab`` within so many edits of each of ``words`` (word), each once.

    Candidates come from an equality join on whole parts (pigeonhole), so no word is compared with the
    whole vocabulary; their distance is then computed.
    """
    own = words.select("word").where("word <> ''").distinct()
    a = own.select("word", F.explode_outer(places_of(F.col("word"), distance)).alias("k")).select("word", "k.*")
    b = vocab.where("term <> ''").select("term", "freq", F.explode_outer(parts_of(F.col("term"), distance)).alias("k")).select("term", "freq", "k.*")
    pairs = a.join(b, ["length", "i", "part"]).select("word", "term", "freq").distinct()
    return pairs.withColumn("d", F.levenshtein("word", "term", distance)).where("d >= 0")


def correct_words(words: DataFrame, vocab: DataFrame, *, distance: int = DISTANCE) -> DataFrame:
    """(word, correction) of rows (word): for each word of three letters or more that the vocabulary lacks, its
    nearest word, the more frequent and then the first of those equally near. No row for the others.

    By rising distance: words that have a term within one edit aren't looked at again, so the short
    parts that two edits ask for meet the other words only.
    """
    unknown = words.select("word").where(F.length("word") >= SHORTEST).distinct().join(vocab, F.col("word") == F.col("term"), "left_anti")
    left, found = unknown, None
    for d in range(1, distance + 1):
        best = near_words(left, vocab, distance=d).groupBy("word").agg(F.min_by("term", F.struct("d", -F.col("freq"), "term")).alias("correction"))
        if d < distance:
            best = materialize(best, "corrections")
            left = left.join(best, "word", "left_anti")
        found = best if found is None else found.unionByName(best)
    return found


def correct_queries(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, query, correction): the queries of which some word is corrected, with all their tokens."""
    words = queries.select("query_id", "query", F.posexplode(tokens(F.col("query"))).alias("no", "word"))
    fixed = words.join(correct_words(words, vocab), "word", "left")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("no", F.coalesce("correction", "word").alias("w")))), lambda x: x["w"])
    # as many as the query has words
    out = fixed.groupBy("query_id", "query").agg(F.array_join(in_order, " ").alias("correction"), F.count("correction").alias("n"))
    return out.where("n > 0").select("query_id", "query", "correction")


def did_you_mean(queries: DataFrame, vocab: DataFrame) -> DataFrame:
    """The corrections that differ from the query as it was typed."""
    return correct_queries(queries, vocab).where(F.lower(F.trim("query")) != F.lower(F.trim("correction")))
