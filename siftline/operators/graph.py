"""The link graph: PageRank, degrees, breadth-first frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.config import DEFAULTS
from siftline.operators.ranks import competition_places
from siftline.storage import as_files, bucketed, materialize, release


def edges_between(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(src, dst): each link between two different nodes once. ``nodes`` has node, ``links`` source_url and
    target_url."""
    known = nodes.select("node").distinct()
    e = links.select(F.col("source_url").alias("src"), F.col("target_url").alias("dst")).where("src <> dst").distinct()
    return e.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")


def pagerank(
    nodes: DataFrame, links: DataFrame, *, damping: float = DEFAULTS.pagerank_damping, iterations: int = DEFAULTS.pagerank_iterations, tolerance: float | None = DEFAULTS.pagerank_tolerance
) -> DataFrame:
    """(node, rank, pagerank_score): ranks that sum to 1, and the same spread over 0 to 1.

    Power iteration; what nodes without links have goes to all nodes alike. Ends when the ranks change
    by less than ``tolerance`` in all, never before ``iterations`` if that is None. One node has the
    rank 1; no nodes give no rows. If all ranks are equal, all scores are 0.

    Edges are written once in buckets of their source, with its number of links, and ranks in as many
    buckets of the node. So an iteration moves partial sums by target and nothing else. It is one job,
    which writes the new ranks to the shared folder; the numbers that the next one needs, the rank
    without links and the change, are sums over that table, and the ranks before are removed.
    """
    n = nodes.select("node").distinct().count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("rank"), F.lit(0.0).alias("pagerank_score")).limit(0)
    out = materialize(edges_between(nodes, links), "graph-edges")
    degree = out.groupBy("src").agg(F.count("*").alias("out"))
    edges = bucketed(out.join(degree, "src"), "graph-edges", "src")
    state = nodes.select("node").distinct().join(degree.withColumnRenamed("src", "node"), "node", "left").select("node", F.coalesce("out", F.lit(0)).alias("out"), F.lit(1.0 / n).alias("rank"))
    state = bucketed(state, "ranks", "node")
    release(out)
    loose = state.where("out = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0]
    for _ in range(iterations if n > 1 else 0):
        base = (1.0 - damping) / n + damping * loose / n
        # partial sums within each task before the exchange, so a target of very many links is no hot key
        sent = edges.join(state.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") / F.col("out")).alias("got"))
        new = state.join(sent, "node", "left").select("node", "out", (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        old, state = state, bucketed(new, "ranks", "node")
        release(old)
        sums = state.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change"), F.coalesce(F.sum(F.when(F.col("out") == 0, F.col("rank"))), F.lit(0.0)).alias("loose")).first()
        loose = sums.loose
        if tolerance is not None and sums.change < tolerance:
            break
    release(edges)
    state = as_files(state)
    whole = state.agg(F.sum("rank").alias("s"), F.min("rank").alias("lo"), F.max("rank").alias("hi")).first()
    rank = F.col("rank") / whole.s
    spread = max((whole.hi - whole.lo) / whole.s, 1e-6)
    return state.select("node", rank.alias("rank"), ((rank - whole.lo / whole.s) / spread).alias("pagerank_score"))


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, inlink_count, outlink_count) of each node, over links to and from anywhere, each pair once."""
    e = links.select("source_url", "target_url").where("source_url <> target_url").distinct()
    into = e.groupBy(F.col("target_url").alias("node")).agg(F.count("*").alias("inlink_count"))
    from_ = e.groupBy(F.col("source_url").alias("node")).agg(F.count("*").alias("outlink_count"))
    both = nodes.select("node").distinct().join(into, "node", "left").join(from_, "node", "left")
    return both.select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("inlink_count", "outlink_count")])


def netloc(url):
    """Host, port and user of a url; null where it has none or can't be read."""
    return F.call_function("try_parse_url", url, F.lit("AUTHORITY"))


def frontier(seeds: DataFrame, links: DataFrame, *, max_depth: int = 3, first_host: str | None = None, hosts: tuple[str, ...] = DEFAULTS.crawl_hosts) -> DataFrame:
    """(url, depth): what a crawl from ``seeds`` (url) reaches, each url at its least depth.

    Level by level: the links of the last level, without what was seen. With ``first_host``, only targets
    on that host or on one that holds a part of ``hosts`` are entered. Blank urls are not.
    """
    level = materialize(seeds.select(F.trim("url").alias("url")).where("url <> ''").distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = level
    for depth in range(1, max_depth + 1):
        next_ = links.join(level.select(F.col("url").alias("source_url")), "source_url", "left_semi").select(F.trim("target_url").alias("url")).where("url <> ''")
        if first_host:
            host = netloc(F.col("url"))
            fits = host == first_host
            for part in hosts:
                fits = fits | host.contains(part)
            next_ = next_.where(fits)
        level = materialize(next_.distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        seen = seen.unionByName(level)
        if level.isEmpty():
            break
    return seen


def crawl(seeds: DataFrame, links: DataFrame, fetched: DataFrame, *, max_depth: int = 3, max_pages: int | None = None) -> DataFrame:
    """(url, depth, outcome, crawl_no): what becomes of each url that a crawl meets.

    ``fetched`` has url, allowed, status and has_text. Outcomes: `denied` and `empty` count nowhere,
    `failed` (status 400 or more, or no answer) counts as failed, `crawled` as a page, numbered by
    depth and url. Links are followed from crawled pages only. With ``max_pages``, urls that come
    after the last page are `queued`.
    """
    known = fetched.select("url", "allowed", "status", "has_text").dropDuplicates(["url"])
    outcome = F.when(~F.coalesce("allowed", F.lit(True)), "denied").when(F.coalesce("status", F.lit(500)) >= 400, "failed").when(~F.coalesce("has_text", F.lit(False)), "empty").otherwise("crawled")
    level = seeds.select(F.trim("url").alias("url")).where("url <> ''").distinct()
    done: DataFrame | None = None
    for depth in range(max_depth + 1):
        own = materialize(level.join(known, "url", "left").select("url", F.lit(depth).alias("depth"), outcome.alias("outcome")), "crawl")
        done = own if done is None else done.unionByName(own)
        pages = own.where("outcome = 'crawled'").select(F.col("url").alias("source_url"))
        level = links.join(pages, "source_url", "left_semi").select(F.trim("target_url").alias("url")).where("url <> ''").distinct().join(done, "url", "left_anti")
    order = [F.when(F.col("outcome") == "crawled", F.col(c)) for c in ("depth", "url")]
    numbered = competition_places(done, [], order, "crawl_no", descending=False)
    numbered = numbered.select("url", "depth", "outcome", F.when(F.col("outcome") == "crawled", F.col("crawl_no")).alias("crawl_no"))
    if max_pages is None:
        return numbered
    last = numbered.where(F.col("crawl_no") == max_pages).select("depth", "url").first()
    if last is None:
        return numbered
    after = (F.col("depth") > last.depth) | ((F.col("depth") == last.depth) & (F.col("url") > last.url))
    return numbered.select("url", "depth", F.when(after, "queued").otherwise(F.col("outcome")).alias("outcome"), F.when(~after, F.col("crawl_no")).alias("crawl_no"))
