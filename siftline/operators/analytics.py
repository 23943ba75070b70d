"""What was searched: summaries of the query log and of the system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalized(query):
    return F.lower(F.trim(query))


def entries(log: DataFrame) -> DataFrame:
    """The log without rows delivered twice, with every query's normal form."""
    own = log.dropDuplicates(["id"])
    return own.withColumn("query_normalized", F.coalesce("query_normalized", normalized(F.col("query"))))


def summary(log: DataFrame, pages: DataFrame, terms: DataFrame) -> DataFrame:
    """One row: searches, different queries, mean time, shares of searches without results and from the cache,
    pages and terms. ``log`` is that of ``entries``; of an empty log all are 0."""
    share = lambda cond: F.round(F.when(F.count("*") > 0, 100.0 * F.count_if(cond) / F.count("*")).otherwise(0.0), 2)
    own = log.agg(
        F.count("*").alias("total_searches"), F.count_distinct("query_normalized").alias("unique_queries"),
        F.round(F.coalesce(F.avg("response_time_ms"), F.lit(0.0)), 2).alias("avg_response_time_ms"),
        share(F.col("results_count") == 0).alias("zero_result_rate_pct"), share(F.col("cache_hit")).alias("cache_hit_rate_pct"),
    )
    return own.crossJoin(pages.agg(F.count("*").alias("total_documents"))).crossJoin(terms.agg(F.count_distinct("term").alias("total_indexed_terms")))


def top_queries(log: DataFrame, *, limit: int = 10) -> DataFrame:
    """The most frequent queries, by their normal form; the first by name of those equally frequent."""
    own = log.groupBy(F.col("query_normalized").alias("query")).agg(
        F.count("*").alias("count"), F.round(F.avg("results_count"), 1).alias("avg_results"),
        F.round(F.avg("response_time_ms"), 2).alias("avg_time_ms"), F.max("searched_at").alias("last_searched"),
    )
    return own.orderBy(F.col("count").desc(), "query").limit(limit)


def system_stats(pages: DataFrame, terms: DataFrame, links: DataFrame, log: DataFrame) -> DataFrame:
    """One row with the sizes of the tables."""
    edges = links.select("source_url", "target_url").distinct()
    return (
        pages.agg(F.count("*").alias("total_documents")).crossJoin(terms.agg(F.count_distinct("term").alias("total_terms")))
        .crossJoin(edges.agg(F.count("*").alias("total_links"))).crossJoin(log.agg(F.count("*").alias("total_searches")))
    )


def click_rates(log: DataFrame, clicks: DataFrame) -> DataFrame:
    """(query, searches, clicks, ctr): clicks (query_id, doc_id) per search of each query. Beyond the usual
    analytics, which record clicks only."""
    per_query = clicks.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"))
    both = log.join(per_query, "id", "left").groupBy(F.col("query_normalized").alias("query"))
    sums = both.agg(F.count("*").alias("searches"), F.coalesce(F.sum("n"), F.lit(0)).alias("clicks"))
    return sums.withColumn("ctr", F.round(F.col("clicks") / F.col("searches"), 4))
