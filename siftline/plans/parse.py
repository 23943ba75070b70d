"""Search queries taken apart into columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import is_stop_word, stems, tokens

# The patterns of the query language.
AND = r"\bAND\b"
SITE = r"(?i)\bsite:([a-zA-Z0-9.-]+)\b"
NOT = r"(?i)\bNOT\s+([a-zA-Z0-9]+)\b"
MINUS = r"-([a-zA-Z0-9]+)\b"
PHRASE = r'"([^"]+)"'
OPERATOR = r"(?i)\b(AND|OR)\b"


def parse(queries: DataFrame, query: str = "query") -> DataFrame:
    """``queries`` with operator, site, excluded, phrases, terms, raw_terms and search_terms.

    In this order: AND makes the operator; the first site: is kept and all go; words after NOT, then
    after a minus sign, are excluded by their stem; quoted phrases go; AND and OR go; the tokens left,
    without stop words and single letters, are the raw terms, and their stems without the excluded
    ones the terms. If none is left, all tokens count, stop words too. Duplicates stay. search_terms
    are the terms, or the raw terms if there are none. A null query has empty columns.
    """
    q = F.coalesce(F.col(query), F.lit(""))
    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    without = lambda text, pattern, by="": F.regexp_replace(text, pattern, by)
    df = queries.withColumn("operator", F.when(q.rlike(AND), "AND").otherwise("OR"))
    df = df.withColumn("site", F.nullif(F.lower(F.regexp_extract(q, SITE, 1)), F.lit("")))
    df = df.withColumn("__q", without(q, SITE))
    df = df.withColumn("__x", found(F.col("__q"), NOT)).withColumn("__q", without(F.col("__q"), NOT))
    df = df.withColumn("__x", F.concat("__x", found(F.col("__q"), MINUS))).withColumn("__q", without(F.col("__q"), MINUS))
    df = df.withColumn("excluded", F.array_sort(F.array_distinct(stems(F.transform("__x", F.lower)))))
    df = df.withColumn("__p", F.transform(found(F.col("__q"), PHRASE), lambda p: F.filter(tokens(p), lambda w: ~is_stop_word(w))))
    df = df.withColumn("phrases", F.filter(F.transform("__p", lambda p: stems(p)), lambda p: F.size(p) > 0))
    df = df.withColumn("__t", tokens(without(without(F.col("__q"), PHRASE), OPERATOR, " ")))
    df = df.withColumn("__k", F.filter("__t", lambda w: ~is_stop_word(w) & (F.length(w) >= 2)))
    kept = lambda words: F.filter(stems(words), lambda w: ~F.array_contains("excluded", w))
    df = df.withColumn("__s", kept(F.col("__k")))
    none = F.size("__s") == 0
    df = df.withColumn("terms", F.when(none, kept(F.col("__t"))).otherwise(F.col("__s")))
    df = df.withColumn("raw_terms", F.when(none & (F.size("__t") > 0), F.col("__t")).otherwise(F.col("__k")))
    df = df.withColumn("search_terms", F.when(F.size("terms") > 0, F.col("terms")).otherwise(F.col("raw_terms")))
    return df.drop("__q", "__x", "__p", "__t", "__k", "__s")
