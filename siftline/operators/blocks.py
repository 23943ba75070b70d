"""Top-k retrieval over a stored index that is cut by pages into blocks.

A row of the index is the list of one term in one block; one more row of a block has the facts of its
pages. The table is sorted by term in ranges, so a look-up of some terms reads few row groups. A batch
of queries is scored block by block: the lists of the asked terms meet in the task that has the block,
each query's scores are summed there in one array, and only its best pages leave the task. No pair of
query and page is a row before that. A task that has found enough pages for a query skips blocks
whose greatest possible score is below the least of them.

Queries that are alike are scored once. The terms that many queries of a batch hold are scored for all of them
together: their best pages by these terms are found once for each different set of them. Then a query looks only
at the pages that hold one of its other terms, as a page without them scores what it has by the common ones, and
takes no place that more than the best pages by the common ones could have.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftline.config import DEFAULTS, Settings
from siftline.operators.index import corpus_stats
from siftline.storage import materialize, partitions

#: Pages of a block at most, on average, and at least where there are enough tasks; queries that are sent to all tasks
#: at once: more go in several rounds.
BLOCK_PAGES, LEAST_PAGES, QUERY_BATCH = 16_384, 512, 50_000
#: A term is common in a batch if so many of its queries hold it, two at least.
COMMON = 0.01

_TYPES = {
    "block": "int", "term": "string", "pages": "array<struct<doc_id: bigint, doc_len: int, pr: double, title: string, domain: string>>",
    "entries": "array<struct<doc_id: bigint, tf: int>>",
}
SCHEMA = ", ".join(f"{c} {t}" for c, t in _TYPES.items())


def block_index(facts: DataFrame, postings: DataFrame) -> DataFrame:
    """The rows of the index (see SCHEMA) of ``facts`` (doc_id, title, domain, pagerank_score, doc_len) and
    ``postings`` (term, doc_id, term_frequency). Lists are bounded by the pages of a block."""
    n = facts.count()
    blocks = max(1, math.ceil(n / BLOCK_PAGES), min(partitions(facts.sparkSession), math.ceil(n / LEAST_PAGES)))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    page = F.struct("doc_id", F.col("doc_len").cast("int").alias("doc_len"), F.coalesce("pagerank_score", F.lit(0.0)).alias("pr"), F.coalesce("title", F.lit("")).alias("title"), "domain")
    none = lambda c: F.lit(None).cast(_TYPES[c]).alias(c)
    pages = facts.groupBy(block).agg(F.sort_array(F.collect_list(page)).alias("pages")).select("block", none("term"), "pages", none("entries"))
    entry = F.struct("doc_id", F.col("term_frequency").alias("tf"))
    lists = postings.groupBy(block, "term").agg(F.sort_array(F.collect_list(entry)).alias("entries")).select("block", "term", none("pages"), "entries")
    return pages.unionByName(lists)


def write(rows: DataFrame, folder: str) -> None:
    """Writes the index in ranges of terms, sorted by term."""
    rows.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(folder)


def document_frequency(index: DataFrame) -> DataFrame:
    """(term, df) from the lists of all blocks."""
    return index.where("term is not null").groupBy("term").agg(F.sum(F.size("entries")).alias("df"))


def _like(pattern: str) -> re.Pattern:
    """ILIKE '%pattern%' as a regular expression."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        else:
            out += ".*" if c == "%" else "." if c == "_" else re.escape(c)
        k += 1
    return re.compile(out, re.I | re.S)


class _Titles:
    """The pages of a block whose titles hold a word. It has no white space, so it is looked for in what stands
    between white space, in each such part once."""

    def __init__(self, titles: list[str]):
        held: dict[str, list[int]] = {}
        for k, title in enumerate(titles):
            for w in set(title.lower().split()):
                held.setdefault(w, []).append(k)
        self.pages = [np.array(p, np.int64) for p in held.values()]
        self.together = "\n".join(held)
        self.begins = [0, *accumulate(len(w) + 1 for w in held)]
        self.known: dict[str, np.ndarray] = {}

    def __call__(self, word: str) -> np.ndarray:
        """Their places in the block, ascending."""
        if word not in self.known:
            sought, own, hit = word.lower(), [], -1
            while (hit := self.together.find(sought, hit + 1)) >= 0:
                k = bisect_right(self.begins, hit) - 1
                own.append(self.pages[k])
                hit = self.begins[k + 1] - 1
            self.known[word] = own[0] if len(own) == 1 else np.unique(np.concatenate(own)) if own else np.empty(0, np.int64)
        return self.known[word]


class _Scorer:
    """Scores the blocks of one task for all queries of the batch."""

    def __init__(self, queries: list[tuple], df: dict[str, int], stats: tuple[int, float], options: dict):
        self.queries, self.df, self.stats, self.o = queries, df, stats, options
        self.number = {t: k for k, t in enumerate(df)}
        n, _ = stats
        d = np.fromiter(df.values(), float, len(df))
        if options["method"] == "tfidf":
            self.idf = np.log10(1.0 + (n - d + 0.5) / (d + 0.5)) if n > 0 else np.zeros(len(d))
        else:
            self.idf = np.log(np.maximum((n - d + 0.5) / (d + 0.5) + 1.0, 1e-6)) if n > 0 else np.zeros(len(d))
        #: The scores found for each query so far, the best ``limit`` of them.
        self.best: list[np.ndarray | None] = [None] * len(queries)
        self.sites = {q[3]: _like(q[3]) for q in queries if q[3] is not None}

    def enter(self, pages: dict, terms: list[str], size: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> None:
        """What all queries need of a block."""
        o, average = self.o, self.stats[1] if self.stats[1] > 0 else 1.0
        self.ids = np.asarray(pages["doc_id"], np.int64)
        self.titles, self.domains = _Titles(pages["title"]), pages["domain"]
        self.at = np.searchsorted(self.ids, doc)
        number = np.fromiter((self.number[t] for t in terms), np.int64, len(terms))
        tf = tf.astype(float)
        idf = np.repeat(self.idf[number], size)
        if o["method"] == "tfidf":
            part = (1.0 + np.log10(np.maximum(tf, 1e-300))) * idf
        else:
            norm = 1.0 - o["b"] + o["b"] * (np.asarray(pages["doc_len"], float)[self.at] / average)
            part = idf * (tf * (o["k1"] + 1.0) / (tf + o["k1"] * norm))
        self.part = part = np.where(tf > 0, part, 0.0)
        ends = np.cumsum(size)
        self.place = {int(k): (int(e - s), int(e)) for k, s, e in zip(number, size, ends)}
        self.most = {int(k): float(m) for k, m in zip(number, np.maximum.reduceat(part, ends - size))} if len(size) else {}
        self.authority = 1.0 + o["authority"] * np.asarray(pages["pr"], float) if o["boosts"] else np.ones(len(self.ids))
        self.greatest = float(self.authority.max(initial=0.0))
        self.on_site: dict[str, np.ndarray] = {}
        self.dense: dict[int, np.ndarray] = {}
        self.titled: dict[str, np.ndarray] = {}

    def pages_on(self, site: str) -> np.ndarray:
        if site not in self.on_site:
            fits = {d: bool(d is not None and self.sites[site].search(d)) for d in set(self.domains)}
            self.on_site[site] = np.array([fits[d] for d in self.domains], bool)
        return self.on_site[site]

    def in_titles(self, word: str) -> np.ndarray:
        """1 for the pages of the block whose title holds the word; for words of many queries."""
        if word not in self.titled:
            self.titled[word] = np.zeros(len(self.ids))
            self.titled[word][self.titles(word)] = 1.0
        return self.titled[word]

    def parts(self, term: int) -> np.ndarray:
        """The term's part of the score of each page of the block; for terms of many queries."""
        if term not in self.dense:
            a, b = self.place[term]
            self.dense[term] = np.zeros(len(self.ids))
            self.dense[term][self.at[a:b]] = self.part[a:b]
        return self.dense[term]

    def floor(self, k: int) -> float:
        """A query's pages of a lower score are not among its best."""
        best = self.best[k]
        return float(best[0]) if best is not None and len(best) >= self.o["limit"] else -math.inf

    def too_low(self, k: int, have: list[tuple[int, int]], raw: list[str]) -> bool:
        bound = sum(n * self.most[t] for t, n in have) * self.greatest * (1.0 + self.o["title"] * len(raw) if self.o["boosts"] else 1.0)
        return round(bound, 4) + 1e-4 < self.floor(k)

    def keep(self, k: int, found: np.ndarray, base: np.ndarray, matches: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """The pages that may be among the best of query ``k``, and their scores."""
        limit = self.o["limit"]
        score = base * (1.0 + self.o["title"] * matches) * self.authority[found] if matches is not None else base
        score = np.floor(np.abs(score) * 1e4 + 0.5) / 1e4 * np.sign(score)
        least = self.floor(k)
        if len(score) > limit:  # with those that tie with the last one
            least = max(least, np.partition(score, len(score) - limit)[len(score) - limit])
        fine = score >= least
        found, score = found[fine], score[fine]
        best = self.best[k]
        best = score if best is None else np.concatenate((best, score))
        self.best[k] = np.sort(best)[-limit:] if len(best) >= limit else best
        return found, score

    def block(self, pages: dict, terms: list[str], size: np.ndarray, doc: np.ndarray, tf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query number, doc_id, score) of the best pages of the block, some queries at a time."""
        self.enter(pages, terms, size, doc, tf)
        out, held = [], 0
        for k, found, score in self.each():
            out.append((np.full(len(found), k), self.ids[found], score))
            held += len(found)
            if held > 50_000:
                yield tuple(np.concatenate(c) for c in zip(*out))
                out, held = [], 0
        if out:
            yield tuple(np.concatenate(c) for c in zip(*out))

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Query number, places of pages in the block, scores."""
        at, part, place = self.at, self.part, self.place
        total, seen = np.zeros(len(self.ids)), np.zeros(len(self.ids), np.int32)
        for k, (_, own, raw, site, all_of, excluded) in enumerate(self.queries):
            have = [(t, n) for t, n in own if t in place]
            if not have or (all_of and len(have) < len(own)) or self.too_low(k, have, raw):
                continue
            total[:] = 0
            if all_of:
                seen[:] = 0
            for t, n in have:
                a, b = place[t]
                total[at[a:b]] += n * part[a:b]
                if all_of:
                    seen[at[a:b]] += 1
            for t in excluded:
                if t in place:
                    total[at[slice(*place[t])]] = 0
            found = np.flatnonzero(total)
            if all_of:
                found = found[seen[found] == len(own)]
            if site is not None:
                found = found[self.pages_on(site)[found]]
            if not len(found):
                continue
            matches = None
            if self.o["boosts"]:
                matches = np.zeros(len(found))
                for t in raw:
                    matches += self.in_titles(t)[found]
            found, score = self.keep(k, found, total[found], matches)
            if len(found):
                yield k, found, score


class _Rest(_Scorer):
    """Scores the pages that hold one of a query's own terms, or one of its own words in the title, by all its terms.

    The queries have, besides, their own terms and words; ``floors`` are the scores of the last page of those
    found by the common terms, where there are enough.
    """

    def __init__(self, queries: list[tuple], df: dict[str, int], stats: tuple[int, float], options: dict, floors: np.ndarray):
        super().__init__(queries, df, stats, options)
        self.floors = floors

    def floor(self, k: int) -> float:
        return max(super().floor(k), self.floors[k])

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        at, part, place = self.at, self.part, self.place
        mark = np.zeros(len(self.ids), bool)
        for k, (_, own, raw, site, all_of, excluded, rare, words) in enumerate(self.queries):
            lists = [at[slice(*place[t])] for t in rare if t in place]
            lists += [p for w in words if len(p := self.titles(w))]
            if not lists:
                continue
            have = [(t, n) for t, n in own if t in place]
            if not have or (all_of and len(have) < len(own)) or self.too_low(k, have, raw):
                continue
            found = lists[0]
            if len(lists) > 1:
                for own_pages in lists:
                    mark[own_pages] = True
                found = np.flatnonzero(mark)
                mark[found] = False
            total = np.zeros(len(found))
            fits = np.ones(len(found), bool)
            for t, n in have:
                a, b = place[t]
                if t in rare:
                    total[np.searchsorted(found, at[a:b])] += n * part[a:b]
                else:
                    total += n * self.parts(t)[found]
                if all_of:
                    fits &= np.isin(found, at[a:b])
            for t in excluded:
                if t in place:
                    fits &= ~np.isin(found, at[slice(*place[t])])
            if site is not None:
                fits &= self.pages_on(site)[found]
            fits &= total != 0
            matches = None
            if self.o["boosts"]:
                matches = np.zeros(len(found))
                for w in raw:
                    if w in words:
                        matches[np.searchsorted(found, self.titles(w))] += 1.0
                    else:
                        matches += self.in_titles(w)[found]
            if not fits.all():
                found, total, matches = found[fits], total[fits], matches[fits] if matches is not None else None
            if not len(found):
                continue
            found, score = self.keep(k, found, total, matches)
            if len(found):
                yield k, found, score


def search_blocks(
    parsed: DataFrame, index: DataFrame, lengths: DataFrame, *, method: str = "bm25", limit: int = 50, domain: str | None = None, boosts: bool = True,
    all_terms: bool = False, exclude: bool = False, settings: Settings = DEFAULTS,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the best ``limit`` pages of each of the ``parsed`` queries; scores have
    four digits. The options are those of ``search``."""
    spark = index.sparkSession
    n, average = corpus_stats(lengths).select("n_docs", "avgdl").first()
    options = {
        "method": method.lower(), "k1": settings.bm25_k1, "b": settings.bm25_b, "title": settings.title_boost, "authority": settings.pagerank_weight, "boosts": boosts, "limit": limit,
    }
    none = F.array().cast("array<string>")
    asked = parsed.select(
        "query_id", F.array_sort("search_terms").alias("search_terms"), (F.array_sort("raw_terms") if boosts else none).alias("raw_terms"), F.coalesce(F.lit(domain), F.col("site")).alias("site"),
        (F.lit(all_terms) & (F.col("operator") == "AND")).alias("all_of"), (F.col("excluded") if exclude else none).alias("excluded"),
    )
    # queries that are alike have the result of the one of the least id
    alike = Window.partitionBy(*[c for c in asked.columns if c != "query_id"])
    asked = materialize(asked.withColumn("as", F.min("query_id").over(alike)), "asked-queries")
    different = asked.where("query_id = `as`").drop("as")
    # the best scores of a round are held by each task
    rounds = max(1, math.ceil(different.count() / max(1, min(QUERY_BATCH, 100 * QUERY_BATCH // max(1, limit)))))
    out = None
    for r in range(rounds):
        some = different.where(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r) if rounds > 1 else different
        # a batch of bounded size
        rows = some.collect()
        scored = _scored(spark, rows, index, (n, average), options)
        out = scored if out is None else out.unionByName(scored)
    ids = asked.select("query_id", F.col("as").alias("alike"))
    return out.join(ids, "alike").select("query_id", "rank", "doc_id", "score")


def _split(queries: list[tuple], boosts: bool) -> tuple[list[tuple], list[int], list[tuple], list[int]]:
    """What is scored for many queries together, for each query its place there or -1, what is left of the queries
    that have terms or words of their own, and their places.

    A page that holds none of a query's own terms, nor an own word of it in its title, has the score that the
    common ones alone give. The other pages have that or more, so none that is not among the ``limit`` best by the
    common ones gets a place but by its own terms and words.
    """
    least = max(2, COMMON * len(queries))
    terms = Counter(t for q in queries for t, _ in q[1])
    words = Counter(w for q in queries for w in set(q[2]))
    together: dict[tuple, int] = {}
    place, rest, rest_of = [], [], []
    for k, (query_id, own, raw, site, all_of, excluded) in enumerate(queries):
        rare = tuple(t for t, _ in own if terms[t] < least)
        seldom = tuple({w: 1 for w in raw if words[w] < least}) if boosts else ()
        common = tuple((t, n) for t, n in own if terms[t] >= least)
        if not common or (all_of and rare):
            place.append(-1)
        else:
            key = (common, tuple(w for w in raw if words[w] >= least), site, all_of, tuple(excluded))
            place.append(together.setdefault(key, len(together)))
        if rare or (seldom and common):
            rest.append((query_id, own, raw, site, all_of, excluded, rare, seldom))
            rest_of.append(k)
    return [(k, list(own), list(raw), site, all_of, list(excluded)) for k, (own, raw, site, all_of, excluded) in enumerate(together)], place, rest, rest_of


def _scored(spark: SparkSession, rows: list, index: DataFrame, stats: tuple[int, float], options: dict) -> DataFrame:
    """(alike, rank, doc_id, score): one batch against all blocks."""
    limit = options["limit"]
    lists = _lists_of(spark, index, sorted({t for r in rows for t in (*r.search_terms, *r.excluded)}))
    df = {r.term: r.df for r in document_frequency(lists).collect()}
    names, number = list(df), {t: k for k, t in enumerate(df)}
    queries = []
    for r in rows:
        count = Counter(r.search_terms)
        own = sorted((number[t], n) for t, n in count.items() if t in number)
        # a page holds all terms only if the collection does
        if own and not (r.all_of and len(own) < len(count)):
            queries.append((r.query_id, own, list(r.raw_terms), r.site, r.all_of, [number[t] for t in r.excluded if t in number]))
    groups, place, rest, rest_of = _split(queries, options["boosts"])
    # of each group its best pages, as arrays of all
    docs, scores, begins = np.empty(0, np.int64), np.empty(0), np.zeros(len(groups) + 1, np.int64)
    if groups:
        shared = _lists_of(spark, index, sorted({names[t] for g in groups for t in (*(t for t, _ in g[1]), *g[5])}))
        found = _best(_in_blocks(spark, index, shared, _Scorer, (groups, df, stats, options)), limit, np.arange(len(groups))).toArrow()
        order = np.lexsort((found.column("rank").to_numpy(), found.column("alike").to_numpy()))
        docs, scores = found.column("doc_id").to_numpy()[order], found.column("score").to_numpy()[order]
        begins = np.searchsorted(found.column("alike").to_numpy()[order], np.arange(len(groups) + 1))
    place = np.array(place, np.int64)
    floors = np.full(len(rest), -math.inf)
    for k, q in enumerate(rest_of):
        if place[q] >= 0 and begins[place[q] + 1] - begins[place[q]] >= limit:
            floors[k] = scores[begins[place[q] + 1] - 1]
    scored = _in_blocks(spark, index, lists, _Rest, (rest, df, stats, options, floors), np.array(rest_of, np.int64))
    # also those queries of which no page was scored
    every = spark.range(len(queries)).select(F.col("id").alias("number"), *[F.lit(None).cast(t).alias(c) for c, t in (("docs", "array<bigint>"), ("scores", "array<double>"))])
    return _best(scored.unionByName(every), limit, np.array([q[0] for q in queries], np.int64), (place, begins, docs, scores))


def _lists_of(spark: SparkSession, index: DataFrame, wanted: list[str]) -> DataFrame:
    """The lists of these terms in all blocks."""
    terms = spark.createDataFrame([(t,) for t in wanted], "term string")
    lists = index.join(F.broadcast(terms), "term", "left_semi")
    if len(wanted) <= 1000:  # row groups without any of them aren't read
        lists = lists.where(F.col("term").isin(wanted))
    return lists


def _in_blocks(spark: SparkSession, index: DataFrame, lists: DataFrame, scorer: Callable[..., _Scorer], of: tuple, numbers: np.ndarray | None = None) -> DataFrame:
    """(number, docs, scores): the pages that the scorer, made with ``of``, finds in each block; a query has the
    number of its place, or that in ``numbers``."""
    known = spark.sparkContext.broadcast((of, numbers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, numbers = known.value
        scores_of = scorer(*of)
        block, pages, lists = None, None, []

        def done() -> Iterator[pa.RecordBatch]:
            if pages is not None and lists:
                terms, size, doc, tf = zip(*lists)
                found = scores_of.block(pages, [t for own in terms for t in own], *(np.concatenate(x) for x in (size, doc, tf)))
                for q, d, s in found:
                    cuts = np.flatnonzero(np.r_[True, q[1:] != q[:-1], True]).astype(np.int32)
                    first = q[cuts[:-1]] if numbers is None else numbers[q[cuts[:-1]]]
                    each = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x)) for x in (d, s)]
                    yield pa.RecordBatch.from_arrays([pa.array(first), *each], ["number", "docs", "scores"])

        for batch in batches:
            of_row = batch.column("block").to_numpy()
            cuts = np.flatnonzero(np.r_[True, of_row[1:] != of_row[:-1]]) if len(of_row) else []
            for lo, hi in zip(cuts, np.r_[cuts[1:], len(of_row)] if len(of_row) else []):
                if of_row[lo] != block:
                    yield from done()
                    block, pages, lists = of_row[lo], None, []
                some = batch.slice(lo, hi - lo)
                facts = some.filter(some.column("term").is_null())
                if facts.num_rows:
                    flat = facts.column("pages").flatten()
                    pages = {c: flat.field(c).to_pylist() for c in ("doc_id", "doc_len", "pr", "title", "domain")}
                own = some.filter(some.column("term").is_valid())
                if own.num_rows:
                    entries = own.column("entries")
                    flat = entries.flatten()
                    size = entries.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                    lists.append((own.column("term").to_pylist(), size, flat.field("doc_id").to_numpy(), flat.field("tf").to_numpy()))
        yield from done()

    facts = index.where("term is null")
    n = min(partitions(spark), 1 + (facts.agg(F.max("block")).first()[0] or 0))
    # by number, since few blocks hashed into few tasks would leave some of them without any
    together = facts.unionByName(lists.select(facts.columns)).repartitionById(n, F.col("block") % n).sortWithinPartitions("block", F.col("term").asc_nulls_first())
    return together.mapInArrow(run, "number long, docs array<bigint>, scores array<double>")


def _best(found: DataFrame, limit: int, ids: np.ndarray, groups: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """(alike, rank, doc_id, score): of the rows of each number its best pages, under the id of its place in ``ids``.

    ``groups`` has for each number its group or -1, where each group begins, and their pages and scores: these
    are taken too where the rows don't have the page.
    """
    spark = found.sparkSession
    known = spark.sparkContext.broadcast((ids, groups))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, groups = known.value
        out, held = [], 0

        def best(number: int, docs: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, ...]:
            if groups is not None and (g := groups[0][number]) >= 0:
                a, b = groups[1][g : g + 2]
                d, s = groups[2][a:b], groups[3][a:b]
                if len(docs):
                    other = ~np.isin(d, docs)
                    d, s = np.r_[docs, d[other]], np.r_[scores, s[other]]
                docs, scores = d, s
            order = np.lexsort((docs, -scores))[:limit]
            return np.full(len(order), ids[number]), np.arange(1, len(order) + 1, dtype=np.int32), docs[order], scores[order]

        def rows() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """Each number with all its rows."""
            last, docs, scores = None, [], []
            for batch in batches:
                number = batch.column("number").to_numpy()
                flat = [batch.column(c).flatten().to_numpy() for c in ("docs", "scores")]
                ends = np.cumsum(batch.column("docs").value_lengths().fill_null(0).to_numpy())
                cuts = np.flatnonzero(np.r_[True, number[1:] != number[:-1], True]) if len(number) else [0]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    if number[lo] != last:
                        if last is not None:
                            yield last, np.concatenate(docs), np.concatenate(scores)
                        last, docs, scores = number[lo], [], []
                    a, b = ends[lo - 1] if lo else 0, ends[hi - 1]
                    docs.append(flat[0][a:b])
                    scores.append(flat[1][a:b])
            if last is not None:
                yield last, np.concatenate(docs), np.concatenate(scores)

        for row in rows():
            out.append(best(*row))
            held += len(out[-1][0])
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["alike", "rank", "doc_id", "score"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], ["alike", "rank", "doc_id", "score"])

    return found.repartition(partitions(spark), "number").sortWithinPartitions("number").mapInArrow(run, "alike long, rank int, doc_id long, score double")
