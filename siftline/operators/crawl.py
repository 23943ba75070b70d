"""A crawl over fetched pages, and the first load of a collection: from raw pages to docs, links and index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.functions.text import word_count
from siftline.operators import graph
from siftline.operators.index import in_place
from siftline.operators.ranks import competition_places
from siftline.sources import html
from siftline.storage import materialize, without_copies


@dataclass
class Crawled:
    """outcomes (url, depth, outcome, crawl_no), docs (url, title, body, description, word_count) after the crawl, the
    links (source_url, target_url, anchor_text) of the crawled pages, each once."""

    outcomes: DataFrame
    docs: DataFrame
    links: DataFrame


def crawl_pages(
    seeds: DataFrame, pages: DataFrame, rules: DataFrame, docs: DataFrame, *, max_depth: int = 3, max_pages: int | None = None, agent: str = "siftline"
) -> Crawled:
    """Crawls from ``seeds`` (url) over fetched ``pages`` (url, html, status, content_type), and stores what it meets.

    A url that isn't among the pages had no answer. Pages are parsed once; robots ``rules`` hold for all
    urls; links are followed from crawled pages only. ``docs`` has url, title, body, description and
    word_count; a page delivered several times counts once. Null and blank urls are left out.
    """
    own = without_copies(pages.where("url is not null"), "url")
    good = html.fetched(own)
    parsed = materialize(html.parse_html(good.withColumn("page", F.col("url")), "page", F.col("url"), F.col("html")).drop("page"), "parsed-pages")
    found = html.first_links(html.links_of(parsed), "ord")
    urls = own.select("url").unionByName(found.select(F.col("target_url").alias("url"))).unionByName(seeds.select(F.trim("url").alias("url"))).where("url <> ''")
    allowed = html.allowed(urls, rules, agent=agent)
    # a page that isn't HTML has no text
    status = own.select("url", F.when(F.col("html").isNotNull() | (F.col("status") >= 400), F.coalesce("status", F.lit(500))).otherwise(F.lit(500)).alias("status"))
    text = parsed.select("url", (F.col("body_text") != "").alias("has_text"))
    known = allowed.join(status, "url", "left").join(text, "url", "left")
    outcomes = materialize(graph.crawl(seeds, found, known, max_depth=max_depth, max_pages=max_pages), "crawl-outcomes")
    crawled = outcomes.where("outcome = 'crawled'").select("url")
    stored = in_place(docs, parsed.join(crawled, "url", "left_semi"))
    return Crawled(outcomes, stored, found.join(crawled.withColumnRenamed("url", "source_url"), "source_url", "left_semi"))


def seed(pages: DataFrame, edges: DataFrame, *, first_id: int = 1) -> tuple[DataFrame, DataFrame]:
    """(docs, links) of a first collection: ``pages`` (url, title, domain, description, body) and ``edges`` (source_url,
    target_url, anchor_text).

    Pages are numbered from ``first_id`` by url; of several pages with one url the first by title and
    body is taken. Words are counted between white space. Whatever rank the pages come with, theirs is
    the scaled PageRank of the edges. Null and blank urls are left out.
    """
    texts = ["title", "domain", "description", "body"]
    one = pages.where("trim(url) <> ''").groupBy("url").agg(F.min(F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in texts])).alias("p")).select("url", "p.*")
    ranks = graph.pagerank(one.select(F.col("url").alias("node")), edges).select(F.col("node").alias("url"), "pagerank_score")
    known = materialize(one.join(ranks, "url"), "seeds")
    ranged = competition_places(known, [], [F.col("url")], "no", descending=False)
    docs = ranged.select(
        (F.col("no") + (first_id - 1)).alias("doc_id"), "url", "title", "description", "body", "domain", F.lit(None).cast("string").alias("language"),
        word_count(F.col("body")).cast("int").alias("word_count"), "pagerank_score", F.lit(None).cast("timestamp").alias("crawled_at"),
    )
    links = edges.where("trim(source_url) <> '' and trim(target_url) <> ''").groupBy("source_url", "target_url").agg(F.min(F.coalesce("anchor_text", F.lit(""))).alias("anchor_text"))
    return docs, links.select("source_url", "target_url", "anchor_text", F.lit(None).cast("timestamp").alias("discovered_at"))
