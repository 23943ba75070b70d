"""Completions of what is typed, from past queries, page titles and fixed phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import DEFAULTS
from siftline.functions.text import SPACE

#: What a phrase adds to its weight: each search that found something, a title, a part of a title, a fixed phrase.
QUERY, TITLE, PART, SEED = 5, 2, 1, 3


def key_of(phrase: Column) -> Column:
    return F.lower(F.trim(phrase))


def weighted(phrases: DataFrame) -> DataFrame:
    """(key, phrase, weight) of rows (phrase, weight, at array<long>): weights add up by key; shown is the form
    that came last, by ``at``. Empty phrases don't count."""
    rows = phrases.where("phrase is not null and phrase <> ''").withColumn("key", key_of(F.col("phrase")))
    return rows.groupBy("key").agg(F.max_by(F.trim("phrase"), "at").alias("phrase"), F.sum("weight").alias("weight"))


def suggestions(log: DataFrame, docs: DataFrame, *, seeds: tuple[str, ...] = DEFAULTS.seed_phrases) -> DataFrame:
    """(key, phrase, weight) of all phrases that may complete what is typed.

    Each logged search that found something counts; each title; for titles of over two words, each run
    of three of its words, and the last two; and the fixed phrases.
    """
    spark = log.sparkSession
    at = lambda *parts: F.array(*[F.lit(p).cast("long") if isinstance(p, int) else p.cast("long") for p in parts])
    n = lambda x: F.lit(x).cast("long").alias("weight")
    queries = log.where("results_count > 0").select(F.col("query").alias("phrase"), n(QUERY), at(0, F.col("id"), 0).alias("at"))
    titles = docs.where("title <> ''").select("doc_id", "title", F.filter(F.split("title", SPACE), lambda w: w != "").alias("words"))
    whole = titles.select(F.col("title").alias("phrase"), n(TITLE), at(1, F.col("doc_id"), 0).alias("at"))
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.array_join(F.slice("words", i, F.lit(3)), " "))
    parts = titles.where(F.size("words") > 2).select("doc_id", F.posexplode(runs).alias("no", "phrase")).select("phrase", n(PART), at(1, F.col("doc_id"), F.col("no") + 1).alias("at"))
    fixed = spark.createDataFrame([(p, SEED, [2, i, 0]) for i, p in enumerate(seeds)], "phrase string, weight long, at array<long>")
    return weighted(queries.unionByName(whole).unionByName(parts).unionByName(fixed))


def add_queries(known: DataFrame, queries: DataFrame) -> DataFrame:
    """``known`` with the new ``queries`` (query, at), each of weight 1 whether it found anything or not."""
    old = known.select("phrase", "weight", F.array(F.lit(-1).cast("long")).alias("at"))
    new = queries.select(F.col("query").alias("phrase"), F.lit(1).cast("long").alias("weight"), F.array(F.col("at").cast("long")).alias("at"))
    return weighted(old.unionByName(new))


def autocomplete(known: DataFrame, prefixes: DataFrame, *, limit: int = 8) -> DataFrame:
    """(prefix, rank, phrase, weight): the heaviest phrases that begin with each prefix; the shorter, then the
    first by key, of those that weigh the same. An empty prefix has none, a blank one all.

    An equality join: each phrase is filed under those of its beginnings that are asked for, so nothing
    is compared with phrases that begin otherwise.
    """
    asked = prefixes.where("prefix <> ''").select("prefix", key_of(F.col("prefix")).alias("start")).distinct()
    # one row: the lengths asked for, at most as many as the longest prefix has letters
    lengths = asked.agg(F.collect_set(F.length("start")).alias("lengths"))
    fitting = F.filter("lengths", lambda n: n <= F.length("key"))
    filed = known.crossJoin(lengths).select("key", "phrase", "weight", F.explode(F.transform(fitting, lambda n: F.substring("key", F.lit(1), n))).alias("start"))
    order = Window.partitionBy("prefix").orderBy(F.col("weight").desc(), F.length("phrase"), "key")
    ranked = asked.join(filed, "start").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return ranked.select("prefix", "rank", "phrase", "weight")
