"""Queries over small given inputs whose results were worked out by hand: they hold the rules themselves, where the SQL
of the other queries is made of the same tables of rules as the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions import text as T
from siftline.operators import graph, search, snippet, spell
from siftline.plans.parse import parse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# Inputs, and what must come of them.
TOKENS = (
    "_foo foo_ foo__bar a-b-c a--b multi-threaded café x–y don’t don't ½ ﬁn ™ C++ node.js 3.14 İstanbul straße हि A_B-c -lead trail- K 9a 𝐀x",
    "a-b-c a b multi-threaded cafe xy dont don t 12 fin tm c node js 3 14 istanbul strae a_b-c lead trail k 9a ax",
)
STEMS = (
    "algorithms algorithm, learning learn, databases database, optimization optimize, classes class, studies study, ties tie, running run, string str, stopped stop, need need, "
    "amazingly amaz, markedly mark, relational relate, educational educate, conditional conditi, information informe, operations opere, selection select, development develop, "
    "darkness dark, readable read, possible poss, quickly quick, syllabus syllabu, structures structure, news new, series sery, bus bus, class class"
)
PAGERANK = {"A": 0.3693233223, "B": 0.2045815282, "C": 0.3784761018, "D": 0.0476190476}
FUSED = [(1, 1, 1.0), (1, None, 0.5), (2, 2, 0.9839), (1, 3, 0.9841)]
PARSES = [
    ('"operating systems" memory -windows site:iitd.ac.in', "memory", "operat system", "window", "iitd.ac.in", "OR"),
    ('Python AND "Machine Learning" NOT syllabus', "python", "machine learn", "syllabu", None, "AND"),
    ("algorithms OR structures NOT java", "algorithm structure", "", "java", None, "OR"),
    ("java -java", "", "", "java", None, "OR"),
    ('"operating systems"', "", "operat system", "", None, "OR"),
    ("multi-threaded", "multi", "", "thread", None, "OR"),
]
DISTANCES = [("algorithm", "algoritm", 1), ("sort", "sort", 0), ("graph", "graphs", 1), ("kitten", "sitting", 3), ("", "abc", 3)]
_LONG = " ".join(["memory" if i == 100 else f"w{i}" for i in range(200)])
SNIPPETS = [
    ("Sorting, sorted & sort_it", "sorting", "<mark>Sorting</mark>, <mark>sorted</mark> & sort_it"),
    ("  A  short\ntext ", "short", "A <mark>short</mark> text"),
    ("", "any", ""),
    (_LONG, "memory", "... " + " ".join(["<mark>memory</mark>" if i == 100 else f"w{i}" for i in range(66, 101)]) + " ..."),
]


def _literal(x) -> str:
    return "NULL" if x is None else repr(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def golden(columns: str, rows: list[tuple]):
    def register(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = f"SELECT {columns} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) t({', '.join(f'c{k}' for k in range(len(rows[0])))})"
        return f

    return register


@golden("c0 AS text, c1 AS tokens", [TOKENS])
def golden_tokens(spark, d):
    return spark.createDataFrame([TOKENS[:1]], "text string").select("text", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@golden("c0 AS word, c1 AS stem", [tuple(x.split()) for x in STEMS.split(", ")])
def golden_stems(spark, d):
    words = spark.createDataFrame([(x.split()[0],) for x in STEMS.split(", ")], "word string")
    return words.select("word", T.stem(F.col("word")).alias("stem"))


@golden("c0 AS method, round(c1::DOUBLE, 12) AS score", [("bm25", 2.4693409015403596), ("tfidf", 1.091692080177392)])
def golden_scores(spark, d):
    x = lambda v: F.lit(float(v))
    bm25, tfidf = search.bm25_score(x(3), x(2), x(100), x(100), x(10)), search.tfidf_score(x(3), x(5), x(10)) + search.tfidf_score(x(2), x(3), x(10))
    return spark.range(1).select(F.explode(F.create_map(F.lit("bm25"), bm25, F.lit("tfidf"), tfidf)).alias("method", "score")).select("method", F.round("score", 12).alias("score"))


@golden("c0 AS node, round(c1::DOUBLE, 8) AS rank", list(PAGERANK.items()))
def golden_pagerank(spark, d):
    links = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "A")], "source_url string, target_url string")
    return graph.pagerank(spark.createDataFrame([(n,) for n in PAGERANK], "node string"), links).select("node", F.round("rank", 8).alias("rank"))


@golden("c0 AS semantic_rank, c1 AS keyword_rank, c2::DOUBLE AS score", FUSED)
def golden_fusion(spark, d):
    lists = [spark.createDataFrame([(q, r[k], 7) for q, r in enumerate(FUSED) if r[k]], "query_id long, rank int, doc_id long") for k in (0, 1)]
    return search.rank_fusion(*lists).select("semantic_rank", "keyword_rank", "score")


@golden("c0 AS query, c1 AS terms, c2 AS phrases, c3 AS excluded, c4 AS site, c5 AS operator", PARSES)
def golden_parses(spark, d):
    parsed = parse(spark.createDataFrame([(k, p[0]) for k, p in enumerate(PARSES)], "query_id long, query string"))
    phrases = F.array_join(F.transform("phrases", lambda p: F.array_join(p, " ")), "|")
    back = spark.createDataFrame([(k, p[0]) for k, p in enumerate(PARSES)], "query_id long, query string")
    return parsed.select("query_id", F.array_join("terms", " ").alias("terms"), phrases.alias("phrases"), F.array_join("excluded", " ").alias("excluded"), "site", "operator").join(back, "query_id").drop("query_id")


@golden("c0 AS a, c1 AS b, c2 AS distance", DISTANCES)
def golden_distances(spark, d):
    return spark.createDataFrame([r[:2] for r in DISTANCES], "a string, b string").withColumn("distance", F.levenshtein("a", "b"))


@golden("c0 AS query, c1 AS correction", [("machne learing", "machine learning")])
def golden_corrections(spark, d):
    vocab = spark.createDataFrame([("machine", 9), ("learning", 9)], "term string, freq long")
    queries = spark.createDataFrame([(1, "machne learing"), (2, "machine"), (3, "")], "query_id long, query string")
    return spell.did_you_mean(queries, vocab).select("query", "correction")


@golden("c0 AS text, c1 AS term, c2 AS snippet", SNIPPETS)
def golden_snippets(spark, d):
    rows = spark.createDataFrame([r[:2] for r in SNIPPETS], "text string, term string")
    return rows.withColumn("snippet", snippet.snippets(F.col("text"), F.array("term")))
