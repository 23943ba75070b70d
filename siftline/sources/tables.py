"""Tables of the engine, their schemas, and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS = {
    "docs": "doc_id long, url string, title string, description string, body string, domain string, language string, word_count int, pagerank_score double, crawled_at timestamp",
    "postings": "term string, doc_id long, term_frequency int, positions array<int>",
    "links": "source_url string, target_url string, anchor_text string, discovered_at timestamp",
    "vectors": "doc_id long, embedding array<float>",
    "query_log": "id long, query string, query_normalized string, results_count int, page int, response_time_ms double, cache_hit boolean, ranking_method string, searched_at timestamp",
    "click_log": "id long, query_id long, doc_id long, result_position int, clicked_url string, clicked_at timestamp",
}


def create(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(SCHEMAS)) -> None:
    """Writes each table of the engine, or of ``names``, that isn't there yet, empty."""
    for name in names:
        spark.createDataFrame([], SCHEMAS[name]).write.mode("ignore").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")


def append(rows: DataFrame, folder: str, name: str) -> None:
    """Adds rows to a log; columns are brought to the table's order and types."""
    fields = [f.split() for f in SCHEMAS[name].split(", ")]
    rows.select(*[rows[c].cast(t).alias(c) for c, t in fields]).write.mode("append").parquet(f"{folder}/{name}")


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A table of a relational database; needs its driver on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def to_jdbc(rows: DataFrame, url: str, name: str, *, mode: str = "append", **options: str) -> None:
    """Writes rows to a table of a relational database."""
    rows.write.format("jdbc").options(url=url, dbtable=name, **options).mode(mode).save()
