"""The positional inverted index and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.functions.text import is_stop_word, tokens, with_stem
from siftline.storage import table, without_copies

TEXTS = ("title", "description", "body")


def pages(docs: DataFrame) -> DataFrame:
    """One row per doc_id, with empty texts for null ones."""
    docs = without_copies(docs, "doc_id")
    return docs.withColumns({c: F.coalesce(c, F.lit("")) for c in TEXTS})


def load_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages(table(spark, sf_dir, "docs"))


def doc_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, tokens): the tokens of title, description and body, in this order.

    Pages are spread by doc_id while they are texts, which are smaller than what is made of them; all
    that is later grouped by page, or page and term, needs no further exchange.
    """
    texts = docs.select("doc_id", F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in TEXTS]).alias("text")).repartition("doc_id")
    return texts.select("doc_id", tokens(F.col("text")).alias("tokens"))


def token_positions(docs: DataFrame) -> DataFrame:
    """(doc_id, token, position), positions from 0 over all tokens.

    An inner explode would have the optimizer filter by the number of tokens first, and so make them twice.
    """
    each = doc_tokens(docs).select("doc_id", F.posexplode_outer("tokens").alias("position", "token"))
    return each.where("token is not null").select("doc_id", "token", "position")


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, term_frequency, positions): stems of all tokens but stop words and single letters.

    The only exchange is that of the texts by page: the aggregation is within each task.
    """
    kept = token_positions(docs).where(~is_stop_word(F.col("token")) & (F.length("token") >= 2))
    return (
        with_stem(kept, "token", "term").groupBy("doc_id", "term")
        .agg(F.count("*").cast("int").alias("term_frequency"), F.sort_array(F.collect_list("position")).alias("positions"))
        .select("term", "doc_id", "term_frequency", "positions")
    )


def distinct_terms(docs: DataFrame) -> DataFrame:
    """(term): the terms of all pages, each once. Tokens are made different before they are stemmed, and no postings."""
    tokens_ = docs.select(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in TEXTS]).alias("text")).select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("token")).distinct()
    return with_stem(tokens_.where(~is_stop_word(F.col("token")) & (F.length("token") >= 2)), "token", "term").select("term").distinct()


def doc_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, word_count): all tokens of a page, stop words too."""
    return doc_tokens(docs).select("doc_id", F.size("tokens").alias("word_count"))


def doc_frequency(postings: DataFrame) -> DataFrame:
    """(term, df): the pages that hold each term."""
    return postings.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """(n_docs, total_words, avgdl) in one row; an empty collection has an average of 100."""
    sums = lengths.agg(F.count("*").alias("n_docs"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"))
    return sums.withColumn("avgdl", F.when(F.col("n_docs") > 0, F.col("total_words") / F.col("n_docs")).otherwise(100.0))


def upsert(index: DataFrame, changed: DataFrame) -> DataFrame:
    """``index`` with the entries of the ``changed`` pages in the place of those it had of them."""
    fresh = postings(changed)
    return index.join(changed.select("doc_id").distinct(), "doc_id", "left_anti").select(fresh.columns).unionByName(fresh)


def in_place(docs: DataFrame, parsed: DataFrame) -> DataFrame:
    """(url, title, body, description, word_count): pages after a crawl, by url.

    A known page keeps its title where the new one is empty; a new page without title has its url.
    """
    new = parsed.select("url", F.col("title").alias("t"), F.col("body_text").alias("b"), F.col("description").alias("d"), F.col("word_count").alias("w"), F.lit(True).alias("fresh"))
    old = docs.select("url", "title", "body", "description", "word_count", F.lit(True).alias("known"))
    both = old.join(new, "url", "full_outer")
    title = F.coalesce(F.nullif("t", F.lit("")), F.when(F.col("known"), F.col("title")).otherwise(F.col("url")))
    pick = lambda new, old: F.when(F.col("fresh"), F.col(new)).otherwise(F.col(old))
    return both.select(
        "url", F.when(F.col("fresh"), title).otherwise(F.col("title")).alias("title"),
        pick("b", "body").alias("body"), pick("d", "description").alias("description"), pick("w", "word_count").alias("word_count"),
    )
