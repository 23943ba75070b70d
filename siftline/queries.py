"""The queries of the core operators, and the SQL they are compared with.

Every query runs over its whole tables. Batches of searches take every different logged query.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline import golden
from siftline import reference_sql as R
from siftline.config import DEFAULTS
from siftline.functions import text as T
from siftline.operators import analytics, blocks, crawl, graph, index, search, semantic, snippet, spell, suggest
from siftline.plans.parse import parse
from siftline.sources import html, tables
from siftline.storage import kept, materialize, shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def joined(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ").alias(column)


# --- text -----------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT doc_id, {T.fold_sql('text')} AS folded FROM documents")
def normalize_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.fold(F.col("text")).alias("folded")).distinct()


@query(f"SELECT DISTINCT doc_id, array_to_string({T.tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens")).distinct()


@query(f"WITH {R.TOKENS} SELECT doc_id, token, position FROM t")
def token_positions(spark, d):
    return index.token_positions(index.load_pages(spark, d))


@query(f"WITH {R.TOKENS} SELECT doc_id, token, count(*) AS n FROM t WHERE NOT {T.is_stop_word_sql('token')} AND length(token) > 1 GROUP BY doc_id, token")
def stopword_filter(spark, d):
    kept = index.token_positions(index.load_pages(spark, d)).where(~T.is_stop_word(F.col("token")) & (F.length("token") > 1))
    return kept.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(f"WITH {R.TOKENS} SELECT token, {T.stem_sql('token')} AS stem FROM (SELECT DISTINCT token FROM t)")
def stem_terms(spark, d):
    return T.with_stem(index.token_positions(index.load_pages(spark, d)).select("token").distinct(), "token", "stem")


@query(f"""WITH a AS (SELECT DISTINCT doc_id, {T.tokens_sql('text')} AS t FROM documents)
SELECT doc_id, array_to_string({R._stems(R._KEPT)}, ' ') AS terms FROM a""")
def normalize_tokens(spark, d):
    own = table(spark, d, "documents").select("doc_id", T.stems(T.content_tokens(T.tokens(F.col("text")))).alias("terms"))
    return own.select("doc_id", joined("terms")).distinct()


# --- index ----------------------------------------------------------------------------------------


@query(f"WITH {R.POSTINGS} SELECT term, doc_id, tf::INTEGER AS term_frequency, array_to_string(positions, ' ') AS positions FROM p")
def postings(spark, d):
    return index.postings(index.load_pages(spark, d)).select("term", "doc_id", "term_frequency", joined("positions"))


@query(f"WITH {R.TOKENS} SELECT doc_id, word_count::INTEGER AS word_count FROM lengths")
def doc_lengths(spark, d):
    return index.doc_lengths(index.load_pages(spark, d))


@query(f"WITH {R.POSTINGS} SELECT term, count(*) AS df FROM p GROUP BY term")
def doc_frequency(spark, d):
    return index.doc_frequency(index.postings(index.load_pages(spark, d)))


@query(f"WITH {R.TOKENS} SELECT count(*) AS n_docs, sum(word_count)::BIGINT AS total_words, round(avg(word_count), 6) AS avgdl FROM lengths")
def corpus_stats(spark, d):
    return index.corpus_stats(index.doc_lengths(index.load_pages(spark, d))).withColumn("avgdl", F.round("avgdl", 6))


@query(f"""WITH {R.POSTINGS}, k AS (SELECT term, doc_id, tf FROM p),
o AS (SELECT DISTINCT term, doc_id, max(term_frequency) AS tf FROM postings WHERE term IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM d WHERE crawled_at >= TIMESTAMP '2025-06-01') GROUP BY term, doc_id)
SELECT term, doc_id, tf::INTEGER AS term_frequency FROM o UNION ALL
SELECT term, doc_id, tf::INTEGER FROM k WHERE doc_id IN (SELECT doc_id FROM d WHERE crawled_at >= TIMESTAMP '2025-06-01')""")
def index_upsert(spark, d):
    """The given index after the pages crawled from June 2025 on are indexed again."""
    given = table(spark, d, "postings").where("term is not null").groupBy("term", "doc_id").agg(F.max("term_frequency").alias("term_frequency"))
    changed = index.load_pages(spark, d).where("crawled_at >= timestamp '2025-06-01 00:00:00'")
    return index.upsert(given.withColumn("positions", F.lit(None).cast("array<int>")), changed).drop("positions")


# --- queries --------------------------------------------------------------------------------------


def logged(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, query): every different logged query under its least id."""
    return table(spark, d, "query_log").where("query is not null").groupBy("query").agg(F.min("id").alias("query_id")).select("query_id", "query")


@query(f"""WITH {R.LOGGED}, {R.PARSED} SELECT query_id, operator, site, array_to_string(excluded, ' ') AS excluded, array_to_string(list_transform(phrases, lambda p: array_to_string(p, ' ')), '|') AS phrases,
array_to_string(terms, ' ') AS terms, array_to_string(raw_terms, ' ') AS raw_terms FROM parsed""")
def parse_queries(spark, d):
    phrases = F.array_join(F.transform("phrases", lambda p: F.array_join(p, " ")), "|").alias("phrases")
    return parse(logged(spark, d)).select("query_id", "operator", "site", joined("excluded"), phrases, joined("terms"), joined("raw_terms"))


class Collection:
    """The pages of docs with their index, which is stored and kept while docs doesn't change."""

    def __init__(self, spark: SparkSession, d: str):
        self.spark, self.source = spark, [f"{d}/docs.parquet"]
        self.docs = index.load_pages(spark, d)
        self.queries = logged(spark, d)

    @property
    def postings(self) -> DataFrame:
        return kept(self.spark, "postings", self.source, lambda: index.postings(self.docs))

    @property
    def lengths(self) -> DataFrame:
        return kept(self.spark, "lengths", self.source, lambda: index.doc_lengths(self.docs))

    @property
    def blocks(self) -> DataFrame:
        facts = search.page_facts(self.docs, self.lengths)
        return kept(self.spark, "blocks", self.source, lambda: blocks.block_index(facts, self.postings), blocks.write)

    def search(self, **options) -> DataFrame:
        return search.search(options.pop("queries", self.queries), self.docs, self.postings, self.lengths, blocks=self.blocks, **options)


@query(f"WITH {R.hits()} {R.top('hits', 10)}")
def bm25_batch_topk(spark, d):
    """The ten best pages of every logged query, with the boosts of title and PageRank."""
    return Collection(spark, d).search(limit=10)


@query(f"WITH {R.hits(boosts=False)} {R.top('hits', 10)}")
def bm25_topk(spark, d):
    """By BM25 alone."""
    return Collection(spark, d).search(limit=10, boosts=False)


@query(f"WITH {R.hits('tfidf')} {R.top('hits', 10)}")
def tfidf_topk(spark, d):
    return Collection(spark, d).search(method="tfidf", limit=10)


@query(f"WITH {R.hits()} {R.top('hits JOIN m USING (doc_id)', 50, '''m.domain ILIKE '%exams%' ''')}")
def domain_filter(spark, d):
    return Collection(spark, d).search(domain="exams", limit=50)


@query(f"""WITH {R.hits()}, r AS ({R.top('hits', 100)})
SELECT r.query_id, r.rank, r.doc_id, r.score, n.total_results, greatest(1, ceil(n.total_results / 10))::BIGINT AS total_pages
FROM r JOIN (SELECT query_id, count(*) AS total_results FROM r GROUP BY query_id) n USING (query_id) WHERE r.rank BETWEEN 11 AND 20""")
def paginate(spark, d):
    """The second page of ten results of every logged query."""
    ranked = materialize(Collection(spark, d).search(limit=DEFAULTS.search_limit), "ranked")
    return search.page_of(ranked, 2, 10)


@query(f"""WITH {R.hits()} {R.top('hits JOIN parsed USING (query_id)', 50, "operator <> 'AND' OR n_terms = len(list_distinct(CASE WHEN len(terms) > 0 THEN terms ELSE raw_terms END))")}""")
def and_search(spark, d):
    """The logged queries, of which those with AND keep only pages that hold every term."""
    return Collection(spark, d).search(all_terms=True)


@query(f"""WITH {R.hits()}, x AS (SELECT DISTINCT query_id, doc_id FROM (SELECT query_id, unnest(excluded) AS term FROM parsed) JOIN p USING (term))
{R.top('hits', 50, '(query_id, doc_id) NOT IN (SELECT (query_id, doc_id) FROM x)')}""")
def exclude_search(spark, d):
    """Pages that hold an excluded term are left out."""
    return Collection(spark, d).search(exclude=True)


def worded(queries: DataFrame) -> DataFrame:
    """Queries that look for the last two words of the logged ones as a phrase besides the words."""
    words = F.filter(F.split("query", " "), lambda w: w.rlike("^[a-z]+$"))
    some = queries.withColumn("w", words).where(F.size("w") >= 2)
    return some.select("query_id", F.concat(F.array_join("w", " "), F.lit(' "'), F.array_join(F.slice("w", -2, 2), " "), F.lit('"')).alias("query"))


_WORDED = R.LOGGED.replace("a AS (", "a_0 AS (") + """,
a_1 AS (SELECT query_id, list_filter(string_split(query, ' '), lambda w: regexp_full_match(w, '[a-z]+')) AS w FROM a_0),
a AS (SELECT query_id, array_to_string(w, ' ') || ' "' || w[-2] || ' ' || w[-1] || '"' AS query FROM a_1 WHERE len(w) >= 2)"""


@query(f"""WITH {R.hits().replace(R.LOGGED, _WORDED)},
ph AS (SELECT query_id, phrase_no, len(phrase) AS n, unnest(phrase) AS term, unnest(range(len(phrase))) AS o FROM (SELECT query_id, unnest(phrases) AS phrase, unnest(range(len(phrases))) AS phrase_no FROM parsed)),
pl AS (SELECT ph.query_id, phrase_no, n, p.doc_id, o, unnest(p.positions) - o AS start FROM ph JOIN p USING (term)),
ok AS (SELECT query_id, doc_id, count(DISTINCT phrase_no) AS held FROM (SELECT query_id, phrase_no, n, doc_id, start FROM pl GROUP BY ALL HAVING count(DISTINCT o) = n) GROUP BY query_id, doc_id)
{R.top('(SELECT h.query_id, h.doc_id, h.score FROM hits h JOIN parsed s USING (query_id) LEFT JOIN ok USING (query_id, doc_id) WHERE coalesce(ok.held, 0) >= len(s.phrases))', 50)}""")
def phrase_search(spark, d):
    """Pages that hold the last two words of a logged query in a row."""
    c = Collection(spark, d)
    return c.search(queries=worded(c.queries), phrases=True)


@query()
def snippets(spark, d):
    """Snippets of the ten best pages of every logged query."""
    c = Collection(spark, d)
    ranked = c.search(limit=10)
    terms = parse(c.queries).select("query_id", F.when(F.size("raw_terms") > 0, F.col("raw_terms")).otherwise(F.col("terms")).alias("w"))
    texts = c.docs.select("doc_id", F.coalesce(F.nullif("body", F.lit("")), "description").alias("text"))
    return ranked.join(terms, "query_id").join(texts, "doc_id").select("query_id", "rank", "doc_id", snippet.snippets(F.col("text"), F.col("w")).alias("snippet"))


@query()
def highlight(spark, d):
    """The titles of the ten best pages of every logged query, with its words marked."""
    c = Collection(spark, d)
    terms = parse(c.queries).select("query_id", "raw_terms")
    shown = search.with_pages(c.search(limit=10), c.docs, c.lengths).join(terms, "query_id")
    return shown.select("query_id", "rank", "doc_id", snippet.highlights(F.col("title"), F.col("raw_terms")).alias("title"))


@query(f"""WITH {R.hits()}, r AS ({R.top('hits', 10)})
SELECT r.query_id, r.rank, r.doc_id, r.score, d.url, coalesce(nullif(d.title, ''), d.url) AS title, d.domain, round(coalesce(d.pagerank_score, 0), 4) AS pagerank_score, n.word_count::INTEGER AS word_count
FROM r JOIN d USING (doc_id) JOIN lengths n USING (doc_id)""")
def search_results(spark, d):
    """What is shown of the ten best pages of every logged query."""
    c = Collection(spark, d)
    return search.with_pages(c.search(limit=10), c.docs, c.lengths).drop("crawled_at")


# --- vectors --------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, rank, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM
(SELECT q.query_id, v.vec_id AS doc_id, round(list_inner_product(q.e, v.embedding::DOUBLE[]), 6) AS score FROM q, embeddings v)) WHERE rank <= 10""")
def cosine_topk(spark, d):
    """The ten nearest of all vectors to each whose id is divisible by 100."""
    v = table(spark, d, "embeddings")
    return semantic.cosine_top(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, 10, doc_id="vec_id")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def ivf_recall(spark, d):
    """Whether the index of all vectors finds 0.9 of the ten nearest, for each query whose id is divisible by 100."""
    v = table(spark, d, "embeddings")
    asked = v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    near = semantic.approximate_top(asked, semantic.index_vectors(v, doc_id="vec_id"), 10).select("query_id", "doc_id", F.lit(1).alias("hit"))
    exact = semantic.cosine_top(asked, v, 10, doc_id="vec_id")
    share = F.sum(F.coalesce("hit", F.lit(0))) / F.count("*")
    return exact.join(near, ["query_id", "doc_id"], "left").agg(F.count_distinct("query_id").alias("queries"), (share >= 0.9).alias("enough"))


@query(f"""WITH {R.DOCS}, q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM (SELECT q.query_id, v.vec_id AS doc_id, round(list_inner_product(q.e, v.embedding::DOUBLE[]), 6) AS score FROM q, embeddings v)) WHERE r <= 100),
j AS (SELECT n.query_id, n.doc_id, n.score, coalesce(d.pagerank_score, 0) AS pr, max(coalesce(d.pagerank_score, 0)) OVER (PARTITION BY n.query_id) AS m FROM n JOIN d USING (doc_id))
{R.top("(SELECT query_id, doc_id, round((1.0::DOUBLE - 0.3::DOUBLE) * score + 0.3::DOUBLE * pr / CASE WHEN m = 0 THEN 1 ELSE m END, 4) AS score FROM j)", 50)}""")
def semantic_blend(spark, d):
    """The nearest pages to each page whose id is divisible by 100, blended with PageRank."""
    v = table(spark, d, "embeddings")
    near = semantic.cosine_top(v.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), v, 100, doc_id="vec_id")
    return semantic.semantic_search(near, index.load_pages(spark, d), limit=50)


@query("""WITH r AS (SELECT query_id, doc_id, ranking_method, min(rank) AS rank FROM results GROUP BY ALL),
s AS (SELECT query_id, doc_id, rank AS semantic_rank FROM r WHERE ranking_method = 'semantic' AND rank <= 100), k AS (SELECT query_id, doc_id, rank AS keyword_rank FROM r WHERE ranking_method = 'bm25' AND rank <= 100),
f AS (SELECT coalesce(s.query_id, k.query_id) AS query_id, coalesce(s.doc_id, k.doc_id) AS doc_id, semantic_rank, keyword_rank FROM s FULL OUTER JOIN k ON s.query_id = k.query_id AND s.doc_id = k.doc_id),
g AS (SELECT *, round((coalesce(1.0::DOUBLE / (60 + semantic_rank), 0) + coalesce(1.0::DOUBLE / (60 + keyword_rank), 0)) / (2.0::DOUBLE / 61), 4) AS score FROM f)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, semantic_rank NULLS LAST, keyword_rank NULLS LAST) AS rank FROM g) WHERE rank <= 50""")
def hybrid_rrf(spark, d):
    """The semantic and keyword lists of results, fused."""
    r = table(spark, d, "results").groupBy("query_id", "doc_id", "ranking_method").agg(F.min("rank").alias("rank"))
    lists = [r.where(F.col("ranking_method") == m).select("query_id", "doc_id", "rank") for m in ("semantic", "bm25")]
    return search.rank_fusion(*lists).select("query_id", "rank", "doc_id", "score")


@query()
def build_embeddings(spark, d):
    """Vectors of all pages by the hashing encoder."""
    return semantic.build(index.load_pages(spark, d))


@query("""SELECT vec_id AS doc_id, len(e) AS n, round(list_sum(e), 6) AS total FROM (SELECT vec_id,
CASE WHEN vec_id % 6 = 0 THEN embedding[1:10] WHEN vec_id % 5 = 0 THEN NULL WHEN vec_id % 4 = 0 THEN list_append(embedding[2:], NULL) ELSE embedding END::DOUBLE[] AS e FROM embeddings)
WHERE len(e) = 64 AND len(list_filter(e, lambda x: x IS NULL)) = 0""")
def vector_load(spark, d):
    """The vectors that can be used, where some are too short, missing, or hold nulls."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    e, n = F.col("embedding"), F.col("doc_id")
    bad = F.when(n % 6 == 0, F.slice(e, 1, 10)).when(n % 5 == 0, F.lit(None)).when(n % 4 == 0, F.concat(F.slice(e, 2, 63), F.array(F.lit(None).cast("float")))).otherwise(e)
    return _vector_facts(semantic.valid(v.withColumn("embedding", bad), 64))


def _vector_facts(v: DataFrame) -> DataFrame:
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return v.select("doc_id", F.size("embedding").cast("long").alias("n"), F.round(total, 6).alias("total"))


@query("""SELECT vec_id AS doc_id, 64::BIGINT AS n, round(CASE WHEN vec_id % 7 = 0 THEN -list_sum(embedding::DOUBLE[]) ELSE list_sum(embedding::DOUBLE[]) END, 6) AS total FROM embeddings WHERE vec_id % 11 <> 0""")
def vector_put(spark, d):
    """The vectors after some were changed, those twice of which the last counts, and some deleted."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    n = F.col("doc_id")
    turned = F.transform("embedding", lambda x: -x)
    changes = [
        v.where(n % 7 == 0).withColumn("changed_at", F.lit(1)), v.where(n % 7 == 0).withColumns({"embedding": turned, "changed_at": F.lit(2)}),
        v.where(n % 11 == 0).withColumns({"embedding": F.lit(None).cast("array<float>"), "changed_at": F.lit(3)}),
    ]
    return _vector_facts(semantic.put(v, reduce(DataFrame.unionByName, changes)))


# --- suggestions and spelling ---------------------------------------------------------------------

_SEEDS = ", ".join(f"('{p}', 3, [2, {i}, 0]::BIGINT[])" for i, p in enumerate(DEFAULTS.seed_phrases))
_SUGGESTIONS = f"""{R.DOCS}, {R.LOGGED},
w AS (SELECT doc_id, title, list_filter(regexp_split_to_array(title, '{T.SPACE_SQL}'), lambda w: w <> '') AS words FROM d WHERE title <> ''),
s(phrase, weight, placed) AS (SELECT query, 5, [0, id, 0]::BIGINT[] FROM l WHERE results_count > 0 UNION ALL SELECT title, 2, [1, doc_id, 0]::BIGINT[] FROM w
UNION ALL SELECT array_to_string(words[i:i + 2], ' '), 1, [1, doc_id, i]::BIGINT[] FROM (SELECT doc_id, words, unnest(range(1, len(words))) AS i FROM w WHERE len(words) > 2) UNION ALL VALUES {_SEEDS}),
k AS (SELECT lower(trim(phrase)) AS key, max_by(trim(phrase), placed) AS phrase, sum(weight)::BIGINT AS weight FROM s WHERE phrase <> '' GROUP BY 1)"""


def _suggestions(spark, d):
    return suggest.suggestions(analytics.entries(table(spark, d, "query_log")), index.load_pages(spark, d))


@query(f"WITH {_SUGGESTIONS} SELECT key, phrase, weight FROM k")
def suggestion_weights(spark, d):
    return _suggestions(spark, d)


@query(f"""WITH {_SUGGESTIONS}, x AS (SELECT DISTINCT substr(query, 1, 3) AS prefix FROM a WHERE query <> '')
SELECT prefix, rank, phrase, weight FROM (SELECT x.prefix, k.phrase, k.weight, row_number() OVER (PARTITION BY x.prefix ORDER BY k.weight DESC, length(k.phrase), k.key) AS rank
FROM x JOIN k ON starts_with(k.key, lower(trim(x.prefix)))) WHERE rank <= 8""")
def autocomplete(spark, d):
    """Completions of the first three characters of every logged query."""
    prefixes = logged(spark, d).select(F.substring("query", 1, 3).alias("prefix")).where("prefix <> ''").distinct()
    return suggest.autocomplete(_suggestions(spark, d), prefixes)


@query(f"""WITH {_SUGGESTIONS}, more(phrase, weight, placed) AS (SELECT phrase, weight, [-1]::BIGINT[] FROM k UNION ALL SELECT query, 1, [id]::BIGINT[] FROM l WHERE NOT coalesce(cache_hit, false) AND query <> '')
SELECT lower(trim(phrase)) AS key, max_by(trim(phrase), placed) AS phrase, sum(weight)::BIGINT AS weight FROM more WHERE phrase <> '' GROUP BY 1""")
def suggestion_add(spark, d):
    """The suggestions after each logged search that didn't come from the cache is added, whether it found anything or not."""
    log = analytics.entries(table(spark, d, "query_log"))
    new = log.where("not coalesce(cache_hit, false) and query <> ''").select("query", F.col("id").alias("at"))
    return suggest.add_queries(_suggestions(spark, d), new)


_COMMON = ", ".join(f"('{w}')" for w in DEFAULTS.common_words)
_VOCABULARY = f"""{R.POSTINGS}, {R.LOGGED}, df AS (SELECT term, count(*) AS freq FROM p GROUP BY term),
vocab AS (SELECT term, freq FROM df UNION ALL SELECT w, 5 FROM (VALUES {_COMMON}) c(w) WHERE w NOT IN (SELECT term FROM df)),
qw AS (SELECT query_id, query, unnest(q) AS word, unnest(range(len(q))) AS no FROM (SELECT query_id, query, {T.tokens_sql('query')} AS q FROM a)),
u AS (SELECT DISTINCT word FROM qw WHERE length(word) >= 3 AND word NOT IN (SELECT term FROM vocab)),
pairs AS (SELECT word, term, freq, levenshtein(word, term) AS dist FROM u JOIN vocab ON abs(length(word) - length(term)) <= 2 WHERE levenshtein(word, term) <= 2),
fix AS (SELECT word, arg_min(term, (dist, -freq, term)) AS correction FROM pairs GROUP BY word)"""


def _vocabulary(spark, d):
    return spell.vocabulary(index.doc_frequency(Collection(spark, d).postings))


@query(f"WITH {_VOCABULARY} SELECT term, freq FROM vocab")
def spell_vocabulary(spark, d):
    return _vocabulary(spark, d)


@query(f"""WITH {_VOCABULARY}, x AS (SELECT DISTINCT word FROM qw) SELECT word, term, levenshtein(word, term) AS distance FROM x JOIN vocab ON abs(length(word) - length(term)) <= 2 WHERE levenshtein(word, term) <= 2""")
def edit_distance(spark, d):
    """All pairs of words of logged queries and terms of the collection that are within two edits of each other."""
    words = logged(spark, d).select(F.explode(T.tokens(F.col("query"))).alias("word"))
    return spell.near_words(words, _vocabulary(spark, d)).select("word", "term", F.col("d").cast("long").alias("distance"))


@query(f"WITH {_VOCABULARY} SELECT word, correction FROM fix")
def spell_correct(spark, d):
    """Corrections of the words of all logged queries."""
    words = logged(spark, d).select(F.explode(T.tokens(F.col("query"))).alias("word"))
    return spell.correct_words(words, _vocabulary(spark, d))


@query(f"""WITH {_VOCABULARY}, c AS (SELECT query_id, query, array_to_string(list(coalesce(correction, word) ORDER BY no), ' ') AS correction, count(correction) AS n FROM qw LEFT JOIN fix USING (word) GROUP BY query_id, query)
SELECT query_id, query, correction FROM c WHERE n > 0 AND lower(trim(query)) <> lower(trim(correction))""")
def did_you_mean(spark, d):
    return spell.did_you_mean(logged(spark, d), _vocabulary(spark, d))


# --- graph ----------------------------------------------------------------------------------------

_GRAPH = f"""{R.DOCS}, n AS (SELECT DISTINCT url AS node FROM d), e AS (SELECT DISTINCT source_url AS src, target_url AS dst FROM links WHERE source_url <> target_url
  AND source_url IN (SELECT node FROM n) AND target_url IN (SELECT node FROM n)),
o AS (SELECT n.node, count(e.dst) AS deg FROM n LEFT JOIN e ON e.src = n.node GROUP BY n.node), c AS (SELECT count(*)::DOUBLE AS n FROM n),
r0 AS MATERIALIZED (SELECT node, deg, 1.0::DOUBLE / c.n AS rank FROM o, c)"""


def _iterations(k: int) -> str:
    return "".join(
        f""", r{i} AS MATERIALIZED (SELECT r.node, r.deg, 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g.got, 0) + z.loose / c.n) AS rank
FROM r{i - 1} r LEFT JOIN (SELECT e.dst, sum(x.rank / x.deg) AS got FROM e JOIN r{i - 1} x ON x.node = e.src GROUP BY e.dst) g ON g.dst = r.node, c, (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) AS loose FROM r{i - 1}) z)"""
        for i in range(1, k + 1)
    )


#: Iterations of the query that SQL follows step by step; the operator's default ends at its tolerance.
ITERATIONS = 10


def _pagerank(spark, d, **options):
    docs = index.load_pages(spark, d)
    return graph.pagerank(docs.select(F.col("url").alias("node")), table(spark, d, "links"), **options)


@query(f"WITH {_GRAPH}{_iterations(ITERATIONS)}, s AS (SELECT sum(rank) AS s FROM r{ITERATIONS}) SELECT node, round(rank / s.s, 9) AS rank FROM r{ITERATIONS}, s")
def pagerank_fixed_iters(spark, d):
    return _pagerank(spark, d, iterations=ITERATIONS, tolerance=None).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH {_GRAPH}{_iterations(ITERATIONS)}, s AS (SELECT sum(rank) AS s, min(rank) AS lo, max(rank) AS hi FROM r{ITERATIONS})
SELECT node, round((rank - s.lo) / s.s / greatest((s.hi - s.lo) / s.s, 1e-6), 6) AS pagerank_score FROM r{ITERATIONS}, s""")
def pagerank_scaled(spark, d):
    return _pagerank(spark, d, iterations=ITERATIONS, tolerance=None).select("node", F.round("pagerank_score", 6).alias("pagerank_score"))


@query(f"""WITH {_GRAPH}{_iterations(ITERATIONS)}, s AS (SELECT sum(rank) AS s FROM r{ITERATIONS})
SELECT node, rank FROM (SELECT node, round(rank / s.s, 9) AS rank FROM r{ITERATIONS}, s) ORDER BY rank DESC, node LIMIT 5""")
def pagerank_top(spark, d):
    """The five pages of greatest rank: a report."""
    return pagerank_fixed_iters(spark, d).orderBy(F.col("rank").desc(), "node").limit(5)


def _until_settled(k: int) -> str:
    """Iterations that leave the ranks as they are once they changed by less than the tolerance."""
    first = ", q0 AS MATERIALIZED (SELECT node, deg, rank, false AS done FROM r0)"
    return first + "".join(
        f""", n{i} AS MATERIALIZED (SELECT r.node, r.deg, r.rank AS old, r.done, CASE WHEN r.done THEN r.rank ELSE 0.15::DOUBLE / c.n + 0.85::DOUBLE * (coalesce(g.got, 0) + z.loose / c.n) END AS rank
FROM q{i - 1} r LEFT JOIN (SELECT e.dst, sum(x.rank / x.deg) AS got FROM e JOIN q{i - 1} x ON x.node = e.src GROUP BY e.dst) g ON g.dst = r.node, c, (SELECT coalesce(sum(rank) FILTER (deg = 0), 0) AS loose FROM q{i - 1}) z),
q{i} AS MATERIALIZED (SELECT node, deg, rank, done OR s.change < {DEFAULTS.pagerank_tolerance} AS done FROM n{i}, (SELECT sum(abs(rank - old)) AS change FROM n{i}) s)"""
        for i in range(1, k + 1)
    )


@query(f"""WITH {_GRAPH}{_until_settled(DEFAULTS.pagerank_iterations)}, w AS (SELECT sum(rank) AS s, min(rank) AS lo, max(rank) AS hi FROM q{DEFAULTS.pagerank_iterations})
SELECT node, round(rank / w.s, 9) AS rank, round((rank - w.lo) / w.s / greatest((w.hi - w.lo) / w.s, 1e-6), 6) AS pagerank_score FROM q{DEFAULTS.pagerank_iterations}, w""")
def pagerank_converged(spark, d):
    """Ranks once they no longer change, to the tolerance."""
    return _pagerank(spark, d).select("node", F.round("rank", 9).alias("rank"), F.round("pagerank_score", 6).alias("pagerank_score"))


@query(f"""WITH {R.DOCS}, e AS (SELECT DISTINCT source_url, target_url FROM links WHERE source_url <> target_url)
SELECT u.url AS node, coalesce(i.n, 0) AS inlink_count, coalesce(o.n, 0) AS outlink_count FROM (SELECT DISTINCT url FROM d) u
LEFT JOIN (SELECT target_url, count(*) AS n FROM e GROUP BY 1) i ON i.target_url = u.url LEFT JOIN (SELECT source_url, count(*) AS n FROM e GROUP BY 1) o ON o.source_url = u.url""")
def inout_degree(spark, d):
    return graph.degrees(index.load_pages(spark, d).select(F.col("url").alias("node")), table(spark, d, "links"))


@query(f"""WITH {R.DOCS}, l0 AS (SELECT url, 0 AS depth FROM d WHERE doc_id = (SELECT min(doc_id) FROM d)), k AS (SELECT source_url, trim(target_url) AS t FROM links WHERE trim(target_url) <> ''),
l1 AS (SELECT DISTINCT t AS url, 1 AS depth FROM k JOIN l0 ON k.source_url = l0.url WHERE t NOT IN (SELECT url FROM l0)), s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
l2 AS (SELECT DISTINCT t AS url, 2 AS depth FROM k JOIN l1 ON k.source_url = l1.url WHERE t NOT IN (SELECT url FROM s1)), s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
l3 AS (SELECT DISTINCT t AS url, 3 AS depth FROM k JOIN l2 ON k.source_url = l2.url WHERE t NOT IN (SELECT url FROM s2)) SELECT * FROM s2 UNION ALL SELECT * FROM l3""")
def bfs_frontier(spark, d):
    """What a crawl from the first page reaches in three steps."""
    docs = index.load_pages(spark, d)
    first = docs.agg(F.min("doc_id")).first()[0]
    return graph.frontier(docs.where(F.col("doc_id") == first).select("url"), table(spark, d, "links"))


@query(f"""WITH {R.DOCS}, f AS (SELECT url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM d WHERE doc_id = (SELECT min(doc_id) FROM d)),
k AS (SELECT source_url, trim(target_url) AS t FROM links, f WHERE trim(target_url) <> '' AND (regexp_extract(trim(target_url), '^[a-z]+://([^/?#]*)', 1) = f.host OR contains(regexp_extract(trim(target_url), '^[a-z]+://([^/?#]*)', 1), 'k'))),
l0 AS (SELECT url, 0 AS depth FROM f),
l1 AS (SELECT DISTINCT t AS url, 1 AS depth FROM k JOIN l0 ON k.source_url = l0.url WHERE t NOT IN (SELECT url FROM l0)), s1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
l2 AS (SELECT DISTINCT t AS url, 2 AS depth FROM k JOIN l1 ON k.source_url = l1.url WHERE t NOT IN (SELECT url FROM s1)), s2 AS (SELECT * FROM s1 UNION ALL SELECT * FROM l2),
l3 AS (SELECT DISTINCT t AS url, 3 AS depth FROM k JOIN l2 ON k.source_url = l2.url WHERE t NOT IN (SELECT url FROM s2)) SELECT * FROM s2 UNION ALL SELECT * FROM l3""")
def bfs_on_hosts(spark, d):
    """What a crawl reaches that stays on the host of its first page and on hosts that hold a certain part."""
    docs = index.load_pages(spark, d)
    first = docs.where(F.col("doc_id") == docs.agg(F.min("doc_id")).first()[0]).select("url", graph.netloc(F.col("url")).alias("host")).first()
    return graph.frontier(spark.createDataFrame([(first.url,)], "url string"), table(spark, d, "links"), first_host=first.host, hosts=("k",))


#: The pages that a crawl may number in the query below.
BUDGET = 60


@query(f"""WITH {R.DOCS}, k0 AS (SELECT url, doc_id % 13 <> 4 AS allowed, CASE WHEN doc_id % 11 = 3 THEN 404 WHEN doc_id % 17 = 5 THEN NULL ELSE 200 END AS status, title || body <> '' AND doc_id % 19 <> 7 AS has_text FROM d),
k AS (SELECT url, CASE WHEN NOT allowed THEN 'denied' WHEN coalesce(status, 500) >= 400 THEN 'failed' WHEN NOT has_text THEN 'empty' ELSE 'crawled' END AS outcome FROM k0),
t AS (SELECT source_url, trim(target_url) AS url FROM links WHERE trim(target_url) <> ''),
l0 AS (SELECT s.url, 0 AS depth, coalesce(k.outcome, 'failed') AS outcome FROM (SELECT DISTINCT url FROM d WHERE doc_id IN (SELECT doc_id FROM d ORDER BY doc_id LIMIT 5)) s LEFT JOIN k USING (url)), s0 AS (SELECT * FROM l0),
{",".join(f"""l{i} AS (SELECT n.url, {i} AS depth, coalesce(k.outcome, 'failed') AS outcome FROM (SELECT DISTINCT t.url FROM t JOIN l{i - 1} p ON p.url = t.source_url AND p.outcome = 'crawled' WHERE t.url NOT IN (SELECT url FROM s{i - 1})) n LEFT JOIN k USING (url)),
s{i} AS (SELECT * FROM s{i - 1} UNION ALL SELECT * FROM l{i})""" for i in (1, 2, 3))},
n AS (SELECT *, CASE WHEN outcome = 'crawled' THEN row_number() OVER (PARTITION BY outcome ORDER BY depth, url) END AS no FROM s3),
z AS (SELECT depth, url FROM n WHERE no = {BUDGET})
SELECT n.url, n.depth, CASE WHEN (n.depth, n.url) > (SELECT (depth, url) FROM z) THEN 'queued' ELSE n.outcome END AS outcome, CASE WHEN (n.depth, n.url) > (SELECT (depth, url) FROM z) THEN NULL ELSE n.no END AS crawl_no FROM n""")
def crawl_outcomes(spark, d):
    """A crawl from the first five pages of docs with what becomes of each url: some are denied by rules, some fail or
    don't answer, some are empty, and there is a budget of pages."""
    docs = index.load_pages(spark, d)
    n = F.col("doc_id")
    known = docs.select("url", (n % 13 != 4).alias("allowed"), F.when(n % 11 == 3, 404).when(n % 17 == 5, F.lit(None)).otherwise(200).alias("status"), ((F.concat("title", "body") != "") & (n % 19 != 7)).alias("has_text"))
    first = docs.orderBy("doc_id").limit(5).select("url")
    return graph.crawl(first, table(spark, d, "links"), known, max_pages=BUDGET)


@query(f"""WITH {R.DOCS}, n AS (SELECT url, title, domain, description, body FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY title, coalesce(domain, ''), description, body) AS no FROM d WHERE trim(url) <> '') WHERE no = 1)
SELECT row_number() OVER (ORDER BY url) AS doc_id, url, title, description, coalesce(domain, '') AS domain, {T.word_count_sql("body")}::INTEGER AS word_count FROM n""")
def seed_load(spark, d):
    """The pages of docs as a first collection: numbered anew, words counted, ranked by their links."""
    docs, _ = crawl.seed(table(spark, d, "docs").select("url", "title", "domain", "description", "body"), table(spark, d, "links"))
    return docs.select("doc_id", "url", "title", "description", "domain", "word_count")


# --- pages ----------------------------------------------------------------------------------------


def as_html(spark: SparkSession, d: str) -> DataFrame:
    """(page_id, url, html, status, content_type, links) of the parsed pages: HTML that holds their texts and links, with
    navigation, scripts and comments around them; some are no HTML, some weren't fetched."""
    p = table(spark, d, "parsed_html").dropDuplicates(["page_id"])
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    anchors = F.array_join(F.transform("links", lambda x: F.concat(F.lit('<a class="x" href="'), safe(x["target_url"]), F.lit('">'), safe(x["anchor"]), F.lit("</a>"))), "\n")
    lines = F.array_join(F.transform(F.split(F.coalesce("body_text", F.lit("")), "\n"), lambda x: F.concat(F.lit("<p>"), safe(x), F.lit("</p>"))), "")
    html_ = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), safe(F.col("title")), F.lit('</title><meta name="description" content="'), safe(F.col("description")),
        F.lit('"><script>if (a < b) { document.write("<p>no</p>"); }</script></head><body><!-- <p>no</p> --><nav>menu <a href="mailto:a@b.example">mail</a></nav>'), lines, F.lit("<div>"),
        F.coalesce(anchors, F.lit("")), F.lit("</div><footer>foot</footer></body></html>"),
    )
    n = F.col("page_id")
    status = F.when(n % 23 == 1, 503).when(n % 29 == 2, F.lit(None)).otherwise(200)
    kind = F.when(n % 19 == 3, F.lit("image/png")).when(n % 7 == 0, F.lit(None)).otherwise(F.lit("text/html; charset=utf-8"))
    return p.select("page_id", "url", html_.alias("html"), status.alias("status"), kind.alias("content_type"))


#: p: each parsed page once; w: white space made one space, none around; t, b, a: what the parser finds.
_HTML = rf"""p AS (SELECT page_id, any_value(url) AS url, any_value(coalesce(title, '')) AS title, any_value(coalesce(description, '')) AS description, any_value(coalesce(body_text, '')) AS body, any_value(links) AS links FROM parsed_html GROUP BY page_id),
h AS (SELECT *, trim(regexp_replace(array_to_string(list_concat([title], string_split(body, chr(10)), list_transform(coalesce(links, []), lambda x: coalesce(x.anchor, ''))), ' '), '{T.SPACE_SQL}', ' ', 'g')) AS words FROM p)"""


@query("""SELECT DISTINCT page_id FROM parsed_html WHERE page_id % 23 <> 1 AND page_id % 29 <> 2 AND page_id % 19 <> 3""")
def fetch_filter(spark, d):
    """The pages that were fetched as HTML."""
    return html.fetched(as_html(spark, d)).select("page_id")


@query(f"""WITH {_HTML} SELECT page_id, url, {T.stripped_sql("title")} AS title, {T.stripped_sql("description")} AS description, words AS body_text, len(list_filter(string_split(words, ' '), lambda w: w <> ''))::INTEGER AS word_count FROM h""")
def html_pages(spark, d):
    """The parsed pages as HTML, parsed again: titles, descriptions and texts without scripts, navigation and footers."""
    return html.parse_html(as_html(spark, d), "page_id", F.col("url"), F.col("html")).drop("links")


@query(f"""WITH {_HTML}, l AS (SELECT url AS source_url, unnest(links) AS l, unnest(range(len(links))) AS ord FROM p)
SELECT source_url, regexp_replace(trim(l.target_url), '#.*$', '') AS target_url, arg_min({T.stripped_sql("coalesce(l.anchor, '')")}, ord) AS anchor_text FROM l WHERE trim(l.target_url) LIKE 'http%' GROUP BY ALL""")
def html_links(spark, d):
    """The links of the parsed pages, read from their HTML: each pair of pages once, with its first anchor on the page."""
    return html.first_links(html.links_of(html.parse_html(as_html(spark, d), "page_id", F.col("url"), F.col("html"))), "ord")


@query(r"SELECT DISTINCT doc_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS netloc FROM docs WHERE url IS NOT NULL")
def page_domain(spark, d):
    return table(spark, d, "docs").where("url is not null").select("doc_id", graph.netloc(F.col("url")).alias("netloc")).distinct()


# invented rules of invented hosts: agent, order, allow, prefix of the path
_ROBOTS = [("*", 0, True, "/s/1"), ("*", 1, False, "/s/"), ("siftline", 2, False, "/u/"), ("other", 3, False, "/")]
_ROBOTS_SQL = ", ".join(f"('{a}', {o}, {str(b).upper()}, '{p}')" for a, o, b, p in _ROBOTS)


@query(f"""WITH u AS (SELECT DISTINCT target_url AS url, regexp_extract(target_url, '^([a-z]+://[^/?#]*)', 1) AS key, coalesce(nullif(regexp_extract(target_url, '^[a-z]+://[^/?#]*([^#]*)', 1), ''), '/') AS path FROM links),
h AS (SELECT DISTINCT key FROM u), r AS (SELECT key, * FROM h, (VALUES {_ROBOTS_SQL}) x(agent, ord, allow, prefix) WHERE x.agent = CASE WHEN key LIKE 'https://e%' THEN 'siftline' ELSE '*' END)
SELECT u.url, coalesce(arg_min(r.allow, r.ord) FILTER (starts_with(u.path, r.prefix)), TRUE) AS allowed FROM u LEFT JOIN r USING (key) GROUP BY u.url""")
def robots_filter(spark, d):
    """All targets of links against rules: hosts that begin with e have one for this agent, all have those for *."""
    links = table(spark, d, "links")
    key = F.regexp_extract("target_url", "^([a-z]+://[^/?#]*)", 1)
    rules = spark.createDataFrame(_ROBOTS, "agent string, ord int, allow boolean, path_prefix string")
    hosts = links.select(key.alias("domain_key")).distinct()
    own = hosts.withColumn("agent", F.explode(F.array(*[F.lit(a) for a in sorted({r[0] for r in _ROBOTS})]))).join(F.broadcast(rules), "agent").where((F.col("agent") != "siftline") | F.col("domain_key").startswith("https://e"))
    return html.allowed(links.select(F.col("target_url").alias("url")), own)


@query(f"""WITH {R.DOCS}, p AS (SELECT DISTINCT * EXCLUDE (links) FROM parsed_html)
SELECT coalesce(p.url, d.url) AS url, CASE WHEN p.url IS NULL THEN d.title ELSE coalesce(nullif(p.title, ''), CASE WHEN d.url IS NULL THEN p.url ELSE d.title END) END AS title,
CASE WHEN p.url IS NULL THEN d.body ELSE p.body_text END AS body, CASE WHEN p.url IS NULL THEN d.description ELSE p.description END AS description,
CASE WHEN p.url IS NULL THEN d.stated ELSE p.word_count END AS word_count FROM d FULL OUTER JOIN p ON d.url = p.url""")
def doc_upsert(spark, d):
    """The pages of docs after the parsed pages are stored."""
    return index.in_place(index.load_pages(spark, d), table(spark, d, "parsed_html").dropDuplicates(["page_id"]))


@query("""SELECT source_url, target_url, arg_min(anchor_text, (discovered_at IS NULL, coalesce(discovered_at, TIMESTAMP '1970-01-01'), anchor_text IS NOT NULL, coalesce(anchor_text, ''))) AS anchor_text
FROM (SELECT source_url, target_url, coalesce(anchor_text, '') AS anchor_text, discovered_at FROM links) GROUP BY source_url, target_url""")
def link_dedupe(spark, d):
    """Each pair of pages once, with the anchor found first."""
    links = table(spark, d, "links").withColumn("anchor_text", F.coalesce("anchor_text", F.lit("")))
    return html.first_links(links, "discovered_at")


# --- analytics ------------------------------------------------------------------------------------


def _log(spark, d):
    return analytics.entries(table(spark, d, "query_log"))


@query(f"""WITH {R.POSTINGS}, {R.LOGGED} SELECT count(*) AS total_searches, count(DISTINCT query_normalized) AS unique_queries, round(coalesce(avg(response_time_ms), 0), 2) AS avg_response_time_ms,
round(100.0::DOUBLE * count(*) FILTER (results_count = 0) / count(*), 2) AS zero_result_rate_pct, round(100.0::DOUBLE * count(*) FILTER (cache_hit) / count(*), 2) AS cache_hit_rate_pct,
(SELECT count(*) FROM d) AS total_documents, (SELECT count(DISTINCT term) FROM p) AS total_indexed_terms FROM l""")
def search_summary(spark, d):
    docs = index.load_pages(spark, d)
    return analytics.summary(_log(spark, d), docs, index.distinct_terms(docs))


@query(f"""WITH {R.LOGGED} SELECT query_normalized AS query, count(*) AS count, round(avg(results_count), 1) AS avg_results, round(avg(response_time_ms), 2) AS avg_time_ms, max(searched_at) AS last_searched
FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def top_queries(spark, d):
    """The ten most frequent queries: a report."""
    return analytics.top_queries(_log(spark, d))


@query("""SELECT id, query, results_count, epoch_us(searched_at) AS searched_us FROM query_log
UNION ALL SELECT id + 1000000, query, results_count, epoch_us(searched_at) FROM query_log WHERE results_count = 0""")
def log_append(spark, d):
    """A stored query log to which the given log was appended, and then a part of it under other numbers."""
    log, folder = table(spark, d, "query_log"), f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    tables.create(spark, folder, ("query_log",))
    tables.append(log, folder, "query_log")
    tables.append(log.where("results_count = 0").withColumn("id", F.col("id") + 1_000_000), folder, "query_log")
    return tables.read(spark, folder, "query_log").select("id", "query", "results_count", F.unix_micros("searched_at").alias("searched_us"))


@query(f"""WITH {R.LOGGED}, c AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, doc_id FROM results WHERE ranking_method = 'bm25' AND rank <= 2) GROUP BY query_id)
SELECT query_normalized AS query, count(*) AS searches, coalesce(sum(c.n), 0)::BIGINT AS clicks, round(coalesce(sum(c.n), 0)::DOUBLE / count(*), 4) AS ctr FROM l LEFT JOIN c ON c.query_id = l.id GROUP BY 1""")
def click_rates(spark, d):
    """Clicks per search of each query, with clicks on the first two results of each query of results."""
    clicks = table(spark, d, "results").where("ranking_method = 'bm25' and rank <= 2").select("query_id", "doc_id").distinct()
    return analytics.click_rates(_log(spark, d), clicks)


@query(f"WITH {R.LOGGED} SELECT query_normalized AS query, round(100.0::DOUBLE * count(*) FILTER (results_count = 0) / count(*), 2) AS zero_result_rate_pct FROM l GROUP BY 1")
def zero_result_rate(spark, d):
    own = _log(spark, d).groupBy(F.col("query_normalized").alias("query"))
    return own.agg(F.round(100.0 * F.count_if(F.col("results_count") == 0) / F.count("*"), 2).alias("zero_result_rate_pct"))


@query(f"""WITH {R.POSTINGS}, {R.LOGGED} SELECT (SELECT count(*) FROM d) AS total_documents, (SELECT count(DISTINCT term) FROM p) AS total_terms,
(SELECT count(*) FROM (SELECT DISTINCT source_url, target_url FROM links)) AS total_links, (SELECT count(*) FROM l) AS total_searches""")
def system_stats(spark, d):
    docs = index.load_pages(spark, d)
    return analytics.system_stats(docs, index.distinct_terms(docs), table(spark, d, "links"), _log(spark, d))


QUERIES |= golden.QUERIES
SQL |= golden.SQL
