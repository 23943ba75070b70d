"""Problem 4: one ranking from several scores on different scales.

Reciprocal rank fusion (Cormack, Clarke and Buettcher 2009): the items of a group are ranked by each
score for itself, an item gets 1 / (k + place) from each list, and the sums give the ranking. Only
places count, so the scale and spread of a score have no weight.

With a small k the first places of a list weigh more than the rest. As k grows the order comes to
that of the plain sum of places: 1 / (k + p) = 1/k - p/k^2 + p^2/k^3 - ..., so from
k = 4 * lists * (longest list)^2 on, no two items whose sums of places differ stand the wrong way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.operators.ranks import competition_places, number
from siftline.storage import table

#: The usual constant of the method.
K = 60


def fuse(df: DataFrame, group: str, item: str, scores: list[str], *, k: float | None = K, name: str = "fused", best_only: bool = False) -> DataFrame:
    """(group, item, places array<long>, place_sum, fused, rank) for each item of each group.

    ``df`` has one row per item; rows repeated for an item count with their greatest scores. places
    has the item's place by each of ``scores``, in that order: 1 plus the number of the group's items
    with a greater value; items whose score is null or NaN share the place after all others. fused is
    the sum of 1 / (k + place); ``k=None`` takes k so large that the order is that of the sum of
    places. rank orders by fused, then by the exact sum of places, then by item. Null groups and
    items are values like others. Other columns are ignored. An empty table gives an empty one.

    With ``best_only`` there is only the first item of each group. No group is held by one task: see
    ``competition_places``; the final rank is one more such list.
    """
    own = df.select(F.col(group).alias("g"), F.col(item).alias("i"), *[number(c).alias(f"s{j}") for j, c in enumerate(scores)])
    own = own.groupBy("g", "i").agg(*[F.max(f"s{j}").alias(f"s{j}") for j in range(len(scores))])
    long = own.select("g", "i", F.posexplode(F.array(*[F.col(f"s{j}") for j in range(len(scores))])).alias("list", "value"))
    placed = competition_places(long, ["g", "list"], [F.col("value")], "place")
    if k is None:
        # one number; with a k so large that doubles no longer tell places apart, place_sum orders
        longest = own.groupBy("g").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        k = 4.0 * len(scores) * longest**2
    share = lambda p: F.lit(1.0) / (F.lit(float(k)) + p)
    per_list = [F.max(F.when(F.col("list") == j, F.col("place"))).alias(f"p{j}") for j in range(len(scores))]
    sums = placed.groupBy("g", "i").agg(*per_list)
    places = [F.col(f"p{j}") for j in range(len(scores))]
    # added in the order of the places, so that items with the same places get the same sum to the last bit
    added = F.aggregate(F.array_sort(F.array(*places)), F.lit(0.0), lambda a, p: a + share(p))
    sums = sums.select("g", "i", F.array(*places).alias("places"), reduce(lambda a, b: a + b, places).alias("place_sum"), added.alias(name))
    order = [(-F.col(name)).alias("a"), F.col("place_sum").alias("b"), F.col("i").alias("c")]
    if best_only:
        best = F.min_by(F.struct(*[c for c in sums.columns if c != "g"]), F.struct(*order)).alias("best")
        ranked = sums.groupBy("g").agg(best).select("g", "best.*").withColumn("rank", F.lit(1).cast("long"))
    else:
        ranked = competition_places(sums, ["g"], order, "rank", descending=False)
    return ranked.select(F.col("g").alias(group), F.col("i").alias(item), "places", "place_sum", name, "rank")


METHODS = ["bm25", "tfidf", "semantic"]


def result_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id, bm25, tfidf, semantic, pagerank_score): one row per item of a query."""
    r = table(spark, sf_dir, "results")
    return r.groupBy("query_id", "doc_id").agg(
        *[F.max(F.when(F.col("ranking_method") == m, number("score"))).alias(m) for m in METHODS],
        F.max(number("pagerank_score")).alias("pagerank_score"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, doc_id): the item of each query that stands first when all four lists weigh alike."""
    fused = fuse(result_items(spark, sf_dir), "query_id", "doc_id", [*METHODS, "pagerank_score"], k=None, best_only=True)
    return fused.select("query_id", "doc_id")


def p4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One ranking of each query's items from the four lists, with the usual constant of the method."""
    fused = fuse(result_items(spark, sf_dir), "query_id", "doc_id", [*METHODS, "pagerank_score"])
    return fused.select("query_id", "doc_id", "place_sum", F.round("fused", 9).alias("fused"), "rank")


_PLACES_SQL = """
WITH i AS (SELECT query_id, doc_id, max(score) FILTER (ranking_method = 'bm25') AS s0,
                  max(score) FILTER (ranking_method = 'tfidf') AS s1,
                  max(score) FILTER (ranking_method = 'semantic') AS s2, max(pagerank_score) AS s3
           FROM results GROUP BY query_id, doc_id),
p AS (SELECT query_id, doc_id,
             rank() OVER (PARTITION BY query_id ORDER BY s0 DESC NULLS LAST) AS p0,
             rank() OVER (PARTITION BY query_id ORDER BY s1 DESC NULLS LAST) AS p1,
             rank() OVER (PARTITION BY query_id ORDER BY s2 DESC NULLS LAST) AS p2,
             rank() OVER (PARTITION BY query_id ORDER BY s3 DESC NULLS LAST) AS p3 FROM i),
q AS (SELECT query_id, doc_id, p0 + p1 + p2 + p3 AS place_sum, list_sort([p0, p1, p2, p3]) AS s FROM p),
f AS (SELECT query_id, doc_id, place_sum,
             1.0::DOUBLE / (60 + s[1]) + 1.0::DOUBLE / (60 + s[2]) + 1.0::DOUBLE / (60 + s[3]) + 1.0::DOUBLE / (60 + s[4]) AS fused FROM q)
"""

SQL = {
    "p4_found": _PLACES_SQL + "SELECT query_id, doc_id FROM q QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place_sum, doc_id) = 1",
    "p4_ranking": _PLACES_SQL + "SELECT query_id, doc_id, place_sum, round(fused, 9) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, place_sum, doc_id) AS rank FROM f",
}
