"""Parts of DuckDB queries that the core operators are compared with."""

from __future__ import annotations

from siftline.functions import text as T
from siftline.plans import parse as P

#: d: pages, each once, with empty texts for null ones.
DOCS = """d AS (SELECT doc_id, url, coalesce(title, '') AS title, coalesce(description, '') AS description, coalesce(body, '') AS body,
  domain, pagerank_score, crawled_at, word_count AS stated FROM (SELECT DISTINCT * FROM docs))"""

#: t: tokens and places of each page; lengths; v: the stems of kept tokens; p: postings.
TOKENS = f"""{DOCS},
tk AS (SELECT doc_id, {T.tokens_sql("title || ' ' || description || ' ' || body")} AS tokens FROM d),
lengths AS (SELECT doc_id, len(tokens) AS word_count FROM tk),
t AS (SELECT doc_id, unnest(tokens) AS token, unnest(range(len(tokens))) AS position FROM tk)"""
POSTINGS = f"""{TOKENS},
v AS (SELECT token, {T.stem_sql("token")} AS term FROM (SELECT DISTINCT token FROM t) WHERE NOT {T.is_stop_word_sql("token")} AND length(token) >= 2),
p AS (SELECT term, doc_id, count(*) AS tf, list_sort(list(position)) AS positions FROM t JOIN v USING (token) GROUP BY term, doc_id)"""

#: a: logged queries, each once under its least id.
LOGGED = """l AS (SELECT id, min(query) AS query, any_value(coalesce(query_normalized, lower(trim(query)))) AS query_normalized, any_value(results_count) AS results_count,
  any_value(response_time_ms) AS response_time_ms, any_value(cache_hit) AS cache_hit, any_value(searched_at) AS searched_at FROM (SELECT DISTINCT * FROM query_log) GROUP BY id),
a AS (SELECT min(id) AS query_id, query FROM l WHERE query IS NOT NULL GROUP BY query)"""


def _stems(words: str) -> str:
    return f"list_transform({words}, lambda x: {_stem('x')})"


def _stem(x: str) -> str:
    staged = f"[{x}]"
    for rules, undouble in ((T.PLURALS, False), (T.VERBS, True), (T.DERIVED, False)):
        staged = f"list_transform({staged}, lambda w: {T._stage_sql('w', rules, undouble)})"
    return f"(CASE WHEN length({x}) <= {T.UNSTEMMED} THEN {x} ELSE ({staged})[1] END)"


_KEPT = f"list_filter(t, lambda w: NOT {T.is_stop_word_sql('w')} AND length(w) >= 2)"

#: parsed: the parts of each query of a.
PARSED = f"""q1 AS (SELECT query_id, query, CASE WHEN regexp_matches(query, '{P.AND}') THEN 'AND' ELSE 'OR' END AS operator,
  nullif(lower(regexp_extract(query, '{P.SITE}', 1)), '') AS site, regexp_replace(query, '{P.SITE}', '', 'g') AS q FROM a),
q2 AS (SELECT *, regexp_extract_all(q, '{P.NOT}', 1) AS x, regexp_replace(q, '{P.NOT}', '', 'g') AS q_2 FROM q1),
q3 AS (SELECT *, list_concat(x, regexp_extract_all(q_2, '{P.MINUS}', 1)) AS x_3, regexp_replace(q_2, '{P.MINUS}', '', 'g') AS q_3 FROM q2),
q4 AS (SELECT query_id, query, operator, site, list_sort(list_distinct({_stems("list_transform(x_3, lambda w: lower(w))")})) AS excluded,
  list_filter(list_transform(regexp_extract_all(q_3, '{P.PHRASE}', 1), lambda p: {_stems(f"list_filter(regexp_extract_all(lower(p), '{T.TOKEN_PATTERN}'), lambda w: NOT {T.is_stop_word_sql('w')})")}), lambda p: len(p) > 0) AS phrases,
  {T.tokens_sql(f"regexp_replace(regexp_replace(q_3, '{P.PHRASE}', '', 'g'), '{P.OPERATOR}', ' ', 'g')")} AS t FROM q3),
q5 AS (SELECT *, {_KEPT} AS k, {_stems(_KEPT)} AS s, {_stems("t")} AS ts FROM q4),
q6 AS (SELECT *, list_filter(s, lambda w: NOT list_contains(excluded, w)) AS s_6, list_filter(ts, lambda w: NOT list_contains(excluded, w)) AS t_6 FROM q5),
parsed AS (SELECT query_id, query, operator, site, excluded, phrases, CASE WHEN len(s_6) = 0 THEN t_6 ELSE s_6 END AS terms,
  CASE WHEN len(s_6) = 0 AND len(t) > 0 THEN t ELSE k END AS raw_terms FROM q6)"""

#: hits: scores of all pages for all queries, before rounding; method bm25 or tfidf.
_LENGTH = f"coalesce(nullif(n.word_count, 0), nullif({T.word_count_sql('d.body')}, 0), 100)"


def hits(method: str = "bm25", boosts: bool = True) -> str:
    if method == "tfidf":
        part = "(1.0::DOUBLE + log10(h.tf)) * log10(1.0::DOUBLE + (c.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE))"
    else:
        part = """ln(greatest((c.n - f.df + 0.5::DOUBLE) / (f.df + 0.5::DOUBLE) + 1.0::DOUBLE, 1e-6)) * (h.tf * 2.5::DOUBLE / (h.tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * (m.doc_len / c.avgdl))))"""
    boost = "* (1.0::DOUBLE + 0.5::DOUBLE * len(list_filter(s.raw_terms, lambda w: contains(lower(m.title), lower(w))))) * (1.0::DOUBLE + 0.3::DOUBLE * coalesce(m.pagerank_score, 0))" if boosts else ""
    return f"""{POSTINGS}, {LOGGED}, {PARSED},
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
c AS (SELECT count(*) AS n, sum(word_count)::DOUBLE / count(*) AS avgdl FROM lengths),
m AS (SELECT d.doc_id, d.title, d.domain, d.pagerank_score, {_LENGTH}::DOUBLE AS doc_len FROM d JOIN lengths n USING (doc_id)),
w AS (SELECT query_id, unnest(CASE WHEN len(terms) > 0 THEN terms ELSE raw_terms END) AS term FROM parsed),
w2 AS (SELECT query_id, term, count(*) AS qtf FROM w GROUP BY query_id, term),
b AS (SELECT w2.query_id, h.doc_id, sum(w2.qtf * {part}) AS base, count(*) AS n_terms
  FROM w2 JOIN p h USING (term) JOIN f USING (term) JOIN m USING (doc_id), c GROUP BY w2.query_id, h.doc_id),
hits AS (SELECT b.query_id, b.doc_id, round(b.base {boost}, 4) AS score, b.n_terms FROM b JOIN parsed s USING (query_id) JOIN m USING (doc_id)
  WHERE s.site IS NULL OR m.domain ILIKE '%' || s.site || '%')"""


def top(rows: str, k: int, where: str = "true") -> str:
    return f"""SELECT query_id, rank, doc_id, score FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank
FROM {rows} WHERE {where}) WHERE rank <= {k}"""
