"""Connected components of an undirected graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.storage import materialize, release


def connected_components(edges: DataFrame, *, max_rounds: int = 60) -> DataFrame:
    """(node, component): for each node of ``edges`` (src, dst) the least node of its component.

    Alternating large-star and small-star (Kiveris et al. 2014). Each round replaces the edges by
    as many or fewer that lead to smaller nodes, until every node hangs on the least one of its
    component; the number of rounds grows with the logarithm of the graph. Aggregates with partial
    sums, joins on node and no collected neighbour list: a node with very many neighbours costs its
    join one skewed key, which adaptive execution splits. Null ends and loops are ignored.
    """
    e = edges.select("src", "dst").where("src is not null and dst is not null and src <> dst")
    e = materialize(e.distinct(), "components")
    state = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.col("src"), F.min("dst")).alias("m"))
        large = both.join(least, "src").where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.where("src <> dst").distinct()
        down = large.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
        least = down.groupBy("src").agg(F.min("dst").alias("m"))
        joined = down.join(least, "src")
        small = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst")).unionByName(
            joined.select("src", F.col("m").alias("dst"))
        )
        old, e = e, materialize(small.where("src <> dst").distinct(), "components")
        release(old)
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")).first()
        if state == (now.n, now.h):
            break
        state = (now.n, now.h)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = e.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("component"))
    return nodes.unionByName(nodes.select(F.col("component").alias("node"), "component").distinct())
