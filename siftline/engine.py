"""One object with all that the engine does, for callers that ask one thing at a time."""

from __future__ import annotations

import math
import time
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.config import DEFAULTS, Settings
from siftline.operators import analytics, blocks, crawl, graph, index, search, semantic, spell, suggest
from siftline.operators.ranks import competition_places
from siftline.operators.cache import ResultCache, cache_key
from siftline.operators.snippet import snippet
from siftline.plans.parse import parse
from siftline.sources import tables
from siftline.storage import materialize, shared_dir

#: Searches and clicks that are kept before they are appended to the stored logs.
LOGGED_TOGETHER = 1000
METHODS = ("bm25", "tfidf", "semantic", "hybrid")
_QUERY = "query_id long, query string"


class Engine:
    """Searches one collection of pages (docs) with its links and query log.

    The index, the vectors and the tables of suggestions and words are made once and written to the
    shared folder; ``changed`` makes them anew and drops cached results. Searches and clicks are
    appended to the tables query_log and click_log of ``folder``, LOGGED_TOGETHER rows at a time and
    whenever they are read; by default the folder is one of its own in the shared folder.
    """

    def __init__(self, docs: DataFrame, links: DataFrame, log: DataFrame | None = None, settings: Settings = DEFAULTS, folder: str | None = None):
        self.spark: SparkSession = docs.sparkSession
        self.settings = settings
        self.links = links
        self.cache = ResultCache(settings.cache_size, settings.cache_seconds)
        self.folder = folder or f"{shared_dir(self.spark)}/engine-{uuid.uuid4().hex}"
        tables.create(self.spark, self.folder, ("query_log", "click_log"))
        self._waiting: dict[str, list[tuple]] = {"query_log": [], "click_log": []}
        self._typed: list[str] = []
        self.old_log = log
        # numbers go on where the stored ones end
        self._next = {name: (tables.read(self.spark, self.folder, name).agg(F.max("id")).first()[0] or 0) + 1 for name in self._waiting}
        if log is not None:
            self._next["query_log"] = max(self._next["query_log"], (log.agg(F.max("id")).first()[0] or 0) + 1)
        self.changed(docs)

    def changed(self, docs: DataFrame) -> None:
        self.docs = materialize(index.pages(docs), "pages")
        self.postings = materialize(index.postings(self.docs), "postings")
        self.lengths = materialize(index.doc_lengths(self.docs), "lengths")
        self._index_blocks()
        self._suggestions = self._vocabulary = self._vectors = None
        self.cache.clear()

    def _index_blocks(self) -> None:
        folder = f"{self.folder}/blocks-{uuid.uuid4().hex}"
        blocks.write(blocks.block_index(search.page_facts(self.docs, self.lengths), self.postings), folder)
        self.blocks = blocks.read(self.spark, folder)

    def _note(self, table: str, row: tuple) -> int:
        number = self._next[table]
        self._next[table] += 1
        self._waiting[table].append((number, *row))
        if len(self._waiting[table]) >= LOGGED_TOGETHER:
            self.flush()
        return number

    def flush(self) -> None:
        """Appends what was searched and clicked since the last time to the stored logs."""
        for name, rows in self._waiting.items():
            if rows:
                tables.append(self.spark.createDataFrame(rows, tables.SCHEMAS[name]), self.folder, name)
                self._waiting[name] = []

    @property
    def log(self) -> DataFrame:
        """The query log: the given one and the stored searches."""
        self.flush()
        own = tables.read(self.spark, self.folder, "query_log")
        return own if self.old_log is None else analytics.entries(self.old_log).select(own.columns).unionByName(own)

    @property
    def clicks(self) -> DataFrame:
        self.flush()
        return tables.read(self.spark, self.folder, "click_log")

    @property
    def suggestions(self) -> DataFrame:
        if self._suggestions is None:
            known = suggest.suggestions(self.log, self.docs, seeds=self.settings.seed_phrases)
            self._suggestions = materialize(known, "suggestions")
            self._typed = []
        elif self._typed:  # all searches since the last time at once
            rows = [(q, k) for k, q in enumerate(self._typed)]
            self._suggestions = materialize(suggest.add_queries(self._suggestions, self.spark.createDataFrame(rows, "query string, at long")), "suggestions")
            self._typed = []
        return self._suggestions

    @property
    def vocabulary(self) -> DataFrame:
        if self._vocabulary is None:
            self._vocabulary = materialize(spell.vocabulary(index.doc_frequency(self.postings), common=self.settings.common_words), "vocabulary")
        return self._vocabulary

    @property
    def vectors(self) -> DataFrame:
        if self._vectors is None:
            self.build_embeddings()
        return self._vectors

    def build_embeddings(self, force: bool = False) -> dict:
        """Encodes the pages without a vector, or all of them."""
        old = None if force else self._vectors
        held = 0 if old is None else old.count()
        self._vectors = materialize(semantic.build(self.docs, old, dim=self.settings.embedding_dim), "vectors")
        total = self._vectors.count()
        return {"embedded_count": total - held, "total_docs": total}

    def ranked(self, queries: DataFrame, method: str = "bm25", domain: str | None = None, limit: int = 50) -> DataFrame:
        """(query_id, rank, doc_id, score) of a batch of queries (query_id, query), by any of the four methods."""
        method = method.lower()
        if method == "semantic":
            asked = semantic.encode(queries, "query_id", "query", dim=self.settings.embedding_dim)
            near = semantic.cosine_top(asked, self.vectors, self.settings.semantic_top_k)
            return semantic.semantic_search(near, self.docs, domain=domain, limit=limit, settings=self.settings)
        if method == "hybrid":
            pool = self.settings.rrf_pool
            words = self.ranked(queries, "bm25", domain, pool)
            site = queries if domain else parse(queries).select("query_id", "site")
            near = self.ranked(queries, "semantic", domain, pool)
            if not domain:  # site: holds for both lists
                asked = site.where("site is not null")
                kept = near.join(asked, "query_id").join(self.docs.select("doc_id", "domain"), "doc_id").where("domain ILIKE concat('%', site, '%')")
                near = near.join(asked, "query_id", "left_anti").unionByName(search.top(kept.select("query_id", "doc_id", "score"), pool))
            return search.rank_fusion(near, words, limit=limit, settings=self.settings).select("query_id", "rank", "doc_id", "score")
        return search.search(queries, self.docs, self.postings, self.lengths, blocks=self.blocks, method=method, limit=limit, domain=domain, settings=self.settings)

    def search(self, query: str, page: int = 1, per_page: int = 10, ranking: str = "bm25", domain: str | None = None) -> dict:
        """One page of results with snippets, a correction, and the number of results, at most search_limit."""
        if not 1 <= len(query) <= 512 or not 1 <= page <= 100 or not 1 <= per_page <= 50 or ranking not in METHODS:
            raise ValueError("query, page, per_page or ranking out of range")
        began = time.time()
        key = cache_key(query, page, per_page, ranking, domain)
        found = self.cache.get(key)
        hit = found is not None
        if not hit:
            asked = self.spark.createDataFrame([(0, query)], _QUERY)
            # bounded by search_limit
            rows = search.with_pages(self.ranked(asked, ranking, domain, self.settings.search_limit), self.docs, self.lengths).orderBy("rank").collect()
            words = parse(asked).select("raw_terms", "terms").first()
            terms = query.split() if ranking == "semantic" else list(words.raw_terms) or list(words.terms)
            shown = rows[(page - 1) * per_page : page * per_page]
            ids = [r.doc_id for r in shown]
            texts = {r.doc_id: r.text for r in self.docs.where(F.col("doc_id").isin(ids)).select("doc_id", F.coalesce(F.nullif("body", F.lit("")), "description").alias("text")).collect()} if ids else {}
            s = self.settings
            results = [{**{k: v for k, v in r.asDict().items() if k != "query_id"}, "snippet": snippet(texts[r.doc_id], terms, s.snippet_length, s.snippet_words, s.snippet_step)} for r in shown]
            found = {
                "query": query, "page": page, "per_page": per_page, "ranking": ranking, "total_results": len(rows),
                "total_pages": max(1, math.ceil(len(rows) / per_page)), "results": results, "did_you_mean": self.spellcheck(query),
            }
            self.cache.put(key, found)
            if self._suggestions is not None:
                self._typed.append(query)
        ms = (time.time() - began) * 1000
        number = self._note("query_log", (query, query.strip().lower(), found["total_results"], page, ms, hit, ranking, datetime.now(timezone.utc)))
        return {**found, "query_id": number, "cache_hit": hit, "response_time_ms": round(ms, 2)}

    def autocomplete(self, prefix: str, limit: int = 8) -> list[str]:
        asked = self.spark.createDataFrame([(prefix,)], "prefix string")
        return [r.phrase for r in suggest.autocomplete(self.suggestions, asked, limit=limit).orderBy("rank").collect()]

    def spellcheck(self, query: str) -> str | None:
        """The corrected query, or None if it needs no correction."""
        row = spell.did_you_mean(self.spark.createDataFrame([(0, query)], _QUERY), self.vocabulary).first()
        return row.correction if row else None

    def recompute_pagerank(self) -> list:
        """Writes each page's scaled PageRank, and gives the five greatest unscaled ones."""
        ranks = graph.pagerank(self.docs.select(F.col("url").alias("node")), self.links)
        ranks = materialize(ranks, "pagerank")
        joined = self.docs.drop("pagerank_score").join(ranks.select(F.col("node").alias("url"), "pagerank_score"), "url", "left")
        self.docs = materialize(joined.select(self.docs.columns), "pages")
        self._index_blocks()
        self.cache.clear()
        return [(r.node, r.rank) for r in ranks.orderBy(F.col("rank").desc(), "node").limit(5).collect()]

    def record_click(self, query_id: int, doc_id: int, position: int, url: str) -> None:
        self._note("click_log", (query_id, doc_id, position, url, datetime.now(timezone.utc)))

    def crawl(self, seeds: list[str], pages: DataFrame, rules: DataFrame, *, max_depth: int = 3, max_pages: int | None = 100) -> dict:
        """Crawls from ``seeds`` over fetched pages (see ``crawl_pages``), stores the pages and links, and makes the index
        anew. Gives the number of urls of each outcome."""
        asked = self.spark.createDataFrame([(u,) for u in seeds], "url string")
        done = crawl.crawl_pages(asked, pages, rules, self.docs, max_depth=max_depth, max_pages=max_pages)
        known = self.docs.select("url", "doc_id", "domain", "language", "pagerank_score", "crawled_at")
        fresh = done.outcomes.where("outcome = 'crawled'").select("url", F.current_timestamp().alias("now"))
        top_id = self.docs.agg(F.max("doc_id")).first()[0] or 0
        merged = materialize(done.docs.join(known, "url", "left").join(fresh, "url", "left"), "crawled-docs")
        new = competition_places(merged.where("doc_id is null").select("url"), [], [F.col("url")], "no", descending=False)
        docs = merged.join(new, "url", "left").select(
            F.coalesce("doc_id", F.col("no") + top_id).alias("doc_id"), "url", "title", "description", "body", F.coalesce("domain", graph.netloc(F.col("url"))).alias("domain"),
            "language", F.col("word_count").cast("int").alias("word_count"), "pagerank_score", F.coalesce("now", "crawled_at").alias("crawled_at"),
        )
        links = self.links.select("source_url", "target_url", "anchor_text").unionByName(done.links).groupBy("source_url", "target_url").agg(F.min("anchor_text").alias("anchor_text"))
        self.links = materialize(links, "links")
        self.changed(docs)
        return {r.outcome: r["count"] for r in done.outcomes.groupBy("outcome").count().collect()}

    @classmethod
    def seeded(cls, pages: DataFrame, edges: DataFrame, **options) -> Engine:
        """An engine over a first collection: see ``seed``."""
        docs, links = crawl.seed(pages, edges)
        return cls(docs, links, **options)

    def analytics(self) -> dict:
        log = self.log
        summary = analytics.summary(log, self.docs, self.postings.select("term")).first().asDict()
        return {**summary, "top_queries": [r.asDict() for r in analytics.top_queries(log).collect()]}

    def stats(self) -> dict:
        sizes = analytics.system_stats(self.docs, self.postings.select("term"), self.links, self.log).first().asDict()
        return {**sizes, "cache": self.cache.stats()}
