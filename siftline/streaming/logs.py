"""Query and click logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.analytics import normalized
from siftline.sources.tables import SCHEMAS


def read_log(spark: SparkSession, folder: str, name: str = "query_log", *, files_at_once: int = 1000) -> DataFrame:
    """A log folder as a stream; new files are new rows."""
    return spark.readStream.schema(SCHEMAS[name]).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def frequent_queries(log: DataFrame, *, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """(window_start, query, count, avg_results): searches of each query in each window of time. Rows delivered
    twice within ``late`` count once; a window is given once no row of it can come any more."""
    own = log.withWatermark("searched_at", late).dropDuplicatesWithinWatermark(["id"])
    query = F.coalesce("query_normalized", normalized(F.col("query"))).alias("query")
    counted = own.groupBy(F.window("searched_at", window).alias("w"), query).agg(F.count("*").alias("count"), F.round(F.avg("results_count"), 1).alias("avg_results"))
    return counted.select(F.col("w.start").alias("window_start"), "query", "count", "avg_results")


def suggestion_weights(log: DataFrame) -> DataFrame:
    """(key, phrase, weight): the weight that logged searches give each phrase, kept up to date."""
    own = log.where("query is not null and trim(query) <> ''").groupBy(normalized(F.col("query")).alias("key"))
    return own.agg(F.max_by(F.trim("query"), "searched_at").alias("phrase"), F.count("*").alias("weight"))
