"""Ranked retrieval for batches of queries: BM25, TF-IDF, filters, fusion, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftline.config import DEFAULTS, Settings
from siftline.functions.numbers import rounded
from siftline.functions.text import word_count
from siftline.operators.blocks import search_blocks
from siftline.operators.index import corpus_stats, doc_frequency
from siftline.plans.parse import parse
from siftline.storage import materialize, partitions


def bm25_idf(df: Column, n: Column) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.log(F.greatest((n - df + 0.5) / (df + 0.5) + 1.0, F.lit(1e-6))))


def bm25_score(tf: Column, df: Column, length: Column, avgdl: Column, n: Column, s: Settings = DEFAULTS) -> Column:
    """One term's part of a page's score."""
    average = F.when(avgdl > 0, avgdl).otherwise(1.0)
    norm = 1.0 - s.bm25_b + s.bm25_b * (length / average)
    return F.when(tf > 0, bm25_idf(df, n) * (tf * (s.bm25_k1 + 1.0) / (tf + s.bm25_k1 * norm))).otherwise(0.0)


def tfidf_score(tf: Column, df: Column, n: Column) -> Column:
    idf = F.when(n <= 0, F.lit(0.0)).otherwise(F.log10(1.0 + (n - df + 0.5) / (df + 0.5)))
    return F.when(tf > 0, (1.0 + F.log10(tf)) * idf).otherwise(0.0)


def page_facts(docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """What scoring needs of each page: its length, and where that is 0 its words between white space, or 100."""
    facts = docs.join(lengths.select("doc_id", F.col("word_count").alias("indexed")), "doc_id", "left")
    length = F.coalesce(F.nullif("indexed", F.lit(0)), F.nullif(word_count(F.col("body")), F.lit(0)), F.lit(DEFAULTS.default_length))
    return facts.withColumns({"word_count": F.coalesce("indexed", F.lit(0)), "doc_len": length}).drop("indexed")


def query_terms(parsed: DataFrame) -> DataFrame:
    """(query_id, term, qtf): how often each term stands in a query."""
    return parsed.select("query_id", F.explode("search_terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def search(
    queries: DataFrame, docs: DataFrame, postings: DataFrame, lengths: DataFrame, *, blocks: DataFrame | None = None, method: str = "bm25", limit: int | None = 50,
    domain: str | None = None, boosts: bool = True, all_terms: bool = False, phrases: bool = False, exclude: bool = False, settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the best ``limit`` pages of each query, all for None.

    ``queries`` has query_id and query. Scores are rounded to four digits before they are ordered; ties
    go by doc_id. ``domain``, or else the query's site:, keeps pages whose domain holds it in any case,
    with the wildcards of ILIKE. By default operators in the query do no more than choose its terms:
    ``all_terms`` keeps pages that hold every term of AND queries, ``phrases`` those that hold each
    phrase in a row, ``exclude`` drops pages that hold an excluded term. An unknown method is BM25.
    With ``blocks``, the index of ``operators.blocks``, and a limit, only the best pages of each block
    become rows; phrases need positions, and look at all pairs of queries and pages.
    """
    # read several times below
    parsed = materialize(parse(queries).where(F.size("search_terms") > 0), "parsed-queries")
    if blocks is not None and limit is not None:
        options = {"method": method, "limit": limit, "domain": domain, "boosts": boosts, "all_terms": all_terms, "exclude": exclude, "settings": settings}
        plain = parsed.where(F.size("phrases") == 0) if phrases else parsed
        found = search_blocks(plain, blocks, lengths, **options)
        if not phrases:
            return found
        parsed = materialize(parsed.where(F.size("phrases") > 0), "parsed-queries")
        if parsed.isEmpty():
            return found
        rest = _search_pairs(parsed, docs, postings, lengths, phrases=True, **options)
        return found.unionByName(rest)
    return _search_pairs(parsed, docs, postings, lengths, method=method, limit=limit, domain=domain, boosts=boosts, all_terms=all_terms, phrases=phrases, exclude=exclude, settings=settings)


def _search_pairs(
    parsed: DataFrame, docs: DataFrame, postings: DataFrame, lengths: DataFrame, *, method: str, limit: int | None, domain: str | None, boosts: bool,
    all_terms: bool, phrases: bool, exclude: bool, settings: Settings,
) -> DataFrame:
    """``search`` with one row for each query and page that holds a term of it, or, with ``phrases``, all phrases."""
    terms = query_terms(parsed)
    asked = postings.join(terms.select("term").distinct(), "term", "left_semi")
    facts = page_facts(docs, lengths)
    needed = facts.select("doc_id", "title", "domain", "pagerank_score", "doc_len")
    c = F.col
    if method.lower() == "tfidf":
        part = tfidf_score(c("term_frequency"), c("df"), c("n_docs"))
    else:
        part = bm25_score(c("term_frequency"), c("df"), c("doc_len"), c("avgdl"), c("n_docs"), settings)
    # a posting scores the same for every query: so postings are scored and spread by page before the queries
    # meet them, and the many pairs of queries and pages are summed where they arise. The number of partitions
    # is stated, since adaptive execution would go by the size of the postings, not by that of the pairs
    scored = asked.join(doc_frequency(asked), "term").crossJoin(corpus_stats(lengths)).join(needed.select("doc_id", "doc_len"), "doc_id")
    scored = scored.select("term", "doc_id", part.alias("part")).repartition(partitions(parsed.sparkSession), "doc_id")
    if phrases and parsed.where(F.size("phrases") == 0).isEmpty():
        # the few pages that hold the phrases come first, then their terms
        pairs = phrase_pages(parsed, postings).join(terms, "query_id")
        met = pairs.join(scored, ["term", "doc_id"])
        phrases = False
    else:
        met = scored.join(terms, "term")
    sums = met.groupBy("query_id", "doc_id").agg(F.sum(c("qtf") * c("part")).alias("base"), F.count("*").alias("n_terms"))
    sums = sums.join(parsed.select("query_id", "raw_terms", "site", "operator", F.size(F.array_distinct("search_terms")).alias("asked")), "query_id")
    # the pages of a partition are hashed, so that the sums need no sort
    sums = sums.join(needed.drop("doc_len").hint("shuffle_hash"), "doc_id")
    wanted = F.coalesce(F.lit(domain), c("site"))
    sums = sums.where(_domain_holds(wanted))
    if all_terms:
        sums = sums.where((c("operator") != "AND") | (c("n_terms") == c("asked")))
    if phrases:
        sums = with_phrases(sums, parsed, postings)
    if exclude:
        banned = parsed.select("query_id", F.explode("excluded").alias("term")).join(postings, "term").select("query_id", "doc_id").distinct()
        sums = sums.join(banned, ["query_id", "doc_id"], "left_anti")
    score = c("base")
    if boosts:
        title = F.lower("title")
        matches = F.size(F.filter("raw_terms", lambda t: F.contains(title, F.lower(t))))
        score = score * (1.0 + settings.title_boost * matches) * (1.0 + settings.pagerank_weight * F.coalesce("pagerank_score", F.lit(0.0)))
    return top(sums.select("query_id", "doc_id", rounded(score, 4).alias("score")), limit)


def _domain_holds(wanted: Column) -> Column:
    """The column domain holds ``wanted`` in any case, % and _ in it as wildcards; all rows if it is null."""
    return wanted.isNull() | F.call_function("ilike", F.col("domain"), F.concat(F.lit("%"), wanted, F.lit("%")))


def top(scored: DataFrame, limit: int | None) -> DataFrame:
    """(query_id, rank, doc_id, score): ranks from 1. With a limit, each task sends its best rows only."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "doc_id", "score")


def phrase_pages(parsed: DataFrame, postings: DataFrame) -> DataFrame:
    """(query_id, doc_id): the pages that hold each phrase of the query, of queries with phrases, in a row.

    Its stems must stand at positions that follow each other; positions count every token of the page.
    The pages of a phrase's rarest stem are the only ones whose positions of the others are looked at.
    """
    asking = parsed.select("query_id", F.explode(F.array_distinct("phrases")).alias("phrase"))
    # each different phrase once, however many queries ask for it
    words = asking.select("phrase").distinct().select("phrase", F.size("phrase").alias("n"), F.posexplode("phrase").alias("offset", "term"))
    asked = postings.join(words.select("term").distinct(), "term", "left_semi")
    rarest = words.join(doc_frequency(asked), "term").groupBy("phrase", "n").agg(F.min_by("term", F.struct("df", "term")).alias("term"))
    pages = rarest.join(asked.select("term", "doc_id"), "term").select("phrase", "doc_id")
    places = pages.join(words, "phrase").join(asked, ["term", "doc_id"]).select("phrase", "n", "doc_id", "offset", "positions")
    # the places where the phrase begins if this word of it is in place; a page and phrase has as many rows as words
    begins = F.transform("positions", lambda x: x - F.col("offset"))
    held = places.groupBy("phrase", "n", "doc_id").agg(F.collect_list(begins).alias("begins"))
    common = F.aggregate(F.slice("begins", 2, F.greatest(F.lit(1), F.size("begins"))), F.col("begins")[0], lambda a, x: F.array_intersect(a, x))
    held = held.where((F.size("begins") == F.col("n")) & (F.size(common) > 0)).select("phrase", "doc_id")
    sizes = parsed.select("query_id", F.size(F.array_distinct("phrases")).alias("n_phrases"))
    counted = asking.join(held, "phrase").groupBy("query_id", "doc_id").agg(F.count("*").alias("held"))
    return counted.join(sizes, "query_id").where("held = n_phrases").select("query_id", "doc_id")


def with_phrases(hits: DataFrame, parsed: DataFrame, postings: DataFrame) -> DataFrame:
    """The rows of ``hits`` whose page holds each phrase of the query in a row; all rows of queries without any."""
    asked = parsed.where(F.size("phrases") > 0)
    rest = hits.join(asked.select("query_id"), "query_id", "left_anti")
    return hits.join(phrase_pages(asked, postings), ["query_id", "doc_id"], "left_semi").unionByName(rest)


def with_pages(ranked: DataFrame, docs: DataFrame, lengths: DataFrame) -> DataFrame:
    """``ranked`` with what a result shows of its page."""
    facts = page_facts(docs, lengths)
    shown = facts.select(
        "doc_id", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), "domain",
        rounded(F.coalesce("pagerank_score", F.lit(0.0)), 4).alias("pagerank_score"), "word_count", "crawled_at",
    )
    return ranked.join(shown, "doc_id")


def page_of(ranked: DataFrame, page: int, per_page: int) -> DataFrame:
    """The results on one page of each query, with the number of results and pages."""
    total = ranked.groupBy("query_id").agg(F.count("*").alias("total_results"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_results") / per_page)).cast("long")
    first = (page - 1) * per_page
    rows = ranked.where((F.col("rank") > first) & (F.col("rank") <= first + per_page))
    return rows.join(total, "query_id").withColumn("total_pages", pages)


def rank_fusion(semantic: DataFrame, keyword: DataFrame, *, limit: int | None = 50, settings: Settings = DEFAULTS) -> DataFrame:
    """(query_id, rank, doc_id, score, semantic_rank, keyword_rank) from two ranked lists of each query.

    The sum of 1 / (k + rank) over the first pool of each list, divided by what rank 1 in both gives.
    Ties keep the order of the lists: the semantic one first, then what only the keyword one has.
    """
    k, pool = settings.rrf_k, settings.rrf_pool
    s = semantic.where(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("semantic_rank"))
    w = keyword.where(F.col("rank") <= pool).select("query_id", "doc_id", F.col("rank").alias("keyword_rank"))
    both = s.join(w, ["query_id", "doc_id"], "full_outer")
    share = lambda r: F.coalesce(1.0 / (F.lit(float(k)) + F.col(r)), F.lit(0.0))
    scored = both.withColumn("score", rounded((share("semantic_rank") + share("keyword_rank")) / (2.0 / (k + 1)), 4))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("semantic_rank").asc_nulls_last(), F.col("keyword_rank").asc_nulls_last())
    ranked = scored.withColumn("rank", F.row_number().over(order))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("query_id", "rank", "doc_id", "score", "semantic_rank", "keyword_rank")
