import math

import pytest
from pyspark.sql import functions as F

from siftline.engine import Engine
from siftline.functions.fold import stem, tokenize
from siftline.functions.text import STOP_WORDS
from siftline.operators import index, search, semantic
from siftline.operators.snippet import highlight, snippet
from siftline.plans.parse import parse
from siftline.sources.tables import SCHEMAS

DOCS = [
    (1, "https://a.example/1", "Sorting algorithms", "On sorting", "Merge sort and quick sort are sorting algorithms taught in every course.", "a.example", "en", 0, 0.5, None),
    (2, "https://b.example/2", "Operating systems", None, "An operating system shares memory between processes. Memory is paged.", "b.example", "en", None, None, None),
    (3, "https://b.example/3", None, "", "Java and python are languages. Sorting in python is easy.", "B.EXAMPLE", "en", 3, 0.1, None),
    (4, "https://c.example/4", "", None, None, None, None, None, None, None),
    (2, "https://b.example/2", "Operating systems", None, "An operating system shares memory between processes. Memory is paged.", "b.example", "en", None, None, None),
]
LINKS = [("https://a.example/1", "https://b.example/2", "os", None), ("https://b.example/2", "https://b.example/3", None, None), ("https://a.example/1", "https://b.example/2", "again", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMAS["docs"])


@pytest.fixture(scope="module")
def made(docs):
    pages = index.pages(docs).cache()
    return pages, index.postings(pages).cache(), index.doc_lengths(pages).cache()


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def python_index():
    out = {}
    for r in DOCS:
        words = tokenize(" ".join(x or "" for x in (r[2], r[3], r[4])))
        kept = {}
        for p, w in enumerate(words):
            if w not in STOP_WORDS and len(w) > 1:
                kept.setdefault(stem(w), []).append(p)
        out[r[0]] = (kept, len(words), r)
    return out


def python_bm25(query):
    idx = python_index()
    n, avgdl = len(idx), sum(x[1] for x in idx.values()) / len(idx)
    raw = [w for w in tokenize(query) if w not in STOP_WORDS and len(w) > 1]
    scores = {}
    for i, (terms, length, r) in idx.items():
        s = 0.0
        for t in map(stem, raw):
            if t in terms:
                df, tf = sum(t in x[0] for x in idx.values()), len(terms[t])
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avgdl))
        if s:
            s *= (1 + 0.5 * sum(t in (r[2] or "").lower() for t in raw)) * (1 + 0.3 * (r[8] or 0))
            scores[i] = round(s, 4)
    return sorted(scores.items(), key=lambda x: (-x[1], x[0]))


def test_index(made):
    _, postings, lengths = made
    idx = python_index()
    assert {(r.doc_id, r.term): r.positions for r in postings.collect()} == {(i, t): p for i, (terms, _, _) in idx.items() for t, p in terms.items()}
    assert {r.doc_id: r.word_count for r in lengths.collect()} == {i: x[1] for i, x in idx.items()}
    stats = index.corpus_stats(lengths).first()
    assert (stats.n_docs, stats.total_words) == (4, sum(x[1] for x in idx.values()))
    assert index.corpus_stats(lengths.limit(0)).first().avgdl == 100.0


@pytest.mark.parametrize("query", ["sorting", "sorting sorting algorithms", "memory of python", "nothing such", "Sorting Python systems"])
def test_bm25_is_that_of_python(spark, made, query):
    got = search.search(queries(spark, query), *made).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in got] == python_bm25(query)


def test_golden_scores(spark):
    one = spark.range(1)
    l = lambda x: F.lit(float(x))
    bm25 = one.select(search.bm25_score(l(3), l(2), l(100), l(100), l(10))).first()[0]
    assert abs(bm25 - 2.4693409015403596) < 1e-12
    tfidf = one.select(search.tfidf_score(l(3), l(5), l(10)) + search.tfidf_score(l(2), l(3), l(10))).first()[0]
    assert abs(tfidf - 1.091692080177392) < 1e-12


PARSES = [
    ('"operating systems" memory -windows site:cs.example', ["memory"], [["operat", "system"]], ["window"], "cs.example", "OR"),
    ('Python AND "Machine Learning" NOT syllabus', ["python"], [["machine", "learn"]], ["syllabu"], None, "AND"),
    ("algorithms OR structures NOT java", ["algorithm", "structure"], [], ["java"], None, "OR"),
    ("java -java", [], [], ["java"], None, "OR"),
    ('"operating systems"', [], [["operat", "system"]], [], None, "OR"),
    ("multi-threaded", ["multi"], [], ["thread"], None, "OR"),
    ("", [], [], [], None, "OR"),
    (None, [], [], [], None, "OR"),
    ("the of", ["the", "of"], [], [], None, "OR"),
]


def test_parse(spark):
    rows = parse(queries(spark, *[p[0] for p in PARSES])).orderBy("query_id").collect()
    for r, (_, terms, phrases, excluded, site, operator) in zip(rows, PARSES):
        assert (r.terms, r.phrases, r.excluded, r.site, r.operator) == (terms, phrases, excluded, site, operator), r
    assert rows[3].search_terms == ["java"] and rows[4].search_terms == []


def test_operators_and_filters(spark, made):
    ids = lambda q, **o: [r.doc_id for r in search.search(queries(spark, q), *made, **o).orderBy("rank").collect()]
    assert set(ids("sorting AND python")) == {1, 3} and ids("sorting AND python", all_terms=True) == [3]
    assert set(ids("sorting -java")) == {1, 3} and ids("sorting -java", exclude=True) == [1]
    assert ids('"operating system"') == [] and ids('memory "operating system"', phrases=True) == [2] and ids('memory "system operating"', phrases=True) == []
    assert ids("java -java") == [3]
    assert ids("sorting site:b.example") == [3] and ids("sorting", domain="A_EX") == [1] and ids("sorting site:a.example", domain="b.") == [3]
    assert ids("sorting", limit=1) == [1]


def test_pages(spark):
    ranked = spark.createDataFrame([(0, r, 100 + r, 1.0) for r in range(1, 24)], "query_id long, rank int, doc_id long, score double")
    got = search.page_of(ranked, 3, 10).collect()
    assert sorted(r["rank"] for r in got) == [21, 22, 23] and {(r.total_results, r.total_pages) for r in got} == {(23, 3)}


@pytest.mark.parametrize("ranks,want", [((1, 1), 1.0), ((1, None), 0.5), ((2, 2), 0.9839), ((1, 3), 0.9841), ((None, 2), 0.4919)])
def test_fusion(spark, ranks, want):
    one = lambda r: spark.createDataFrame([(0, r, 7)] if r else [], "query_id long, rank int, doc_id long")
    assert search.rank_fusion(one(ranks[0]), one(ranks[1])).first().score == want


def test_fusion_ties_put_the_semantic_list_first(spark):
    s = spark.createDataFrame([(0, 1, 9)], "query_id long, rank int, doc_id long")
    k = spark.createDataFrame([(0, 1, 3)], "query_id long, rank int, doc_id long")
    assert [r.doc_id for r in search.rank_fusion(s, k).orderBy("rank").collect()] == [9, 3]


def test_vector_index(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 16))
    v = np.concatenate([c + 0.3 * rng.normal(size=(60, 16)) for c in centres]).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9000, None), (9001, [1.0])]
    df = spark.createDataFrame(rows, "doc_id long, embedding array<float>").repartition(3)
    ask = df.where("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")
    made = semantic.index_vectors(df, sample=500)
    assert made.rows.count() == len(v) and made.rows.select("doc_id").distinct().count() == len(v)
    exact = {(r.query_id, r.doc_id) for r in semantic.cosine_top(ask, df, 10).collect()}
    near = {(r.query_id, r.doc_id) for r in semantic.approximate_top(ask, made, 10, probes=8).collect()}
    assert len(exact & near) >= 0.9 * len(exact) and len(near) == len(exact)
    assert {(r.query_id, r.doc_id) for r in semantic.approximate_top(ask, made, 10, probes=len(made.centroids)).collect()} == exact
    assert semantic.approximate_top(ask.limit(0), made, 10).count() == 0
    assert semantic.approximate_top(ask, semantic.index_vectors(df.limit(0), dim=16), 10).count() == 0


def in_rounds(semantic, df):
    """The same search with queries sent in several rounds."""
    old, semantic.QUERY_BYTES = semantic.QUERY_BYTES, 64
    try:
        return semantic.cosine_top(df.where("doc_id % 50 = 3").withColumnRenamed("doc_id", "query_id"), df, 5).collect()
    finally:
        semantic.QUERY_BYTES = old


def test_put_takes_the_last_change(spark):
    v = spark.createDataFrame([(1, [1.0]), (2, [2.0]), (3, [3.0])], "doc_id long, embedding array<float>")
    c = spark.createDataFrame([(2, [7.0], 1), (2, [5.0], 2), (3, None, 1), (4, [4.0], 1)], "doc_id long, embedding array<float>, changed_at int")
    assert {r.doc_id: r.embedding for r in semantic.put(v, c).collect()} == {1: [1.0], 2: [5.0], 4: [4.0]}
    assert {r.doc_id: r.embedding for r in semantic.put(v, c.drop("changed_at")).collect()}[2] == [7.0]


def test_cosine(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "doc_id long, embedding array<float>").repartition(3)
    got = semantic.cosine_top(df.where("doc_id % 50 = 3").withColumnRenamed("doc_id", "query_id"), df, 5).collect()
    for q in range(3, 300, 50):
        scores = np.round(v.astype(float) @ v[q].astype(float), 6)
        want = sorted(range(300), key=lambda i: (-scores[i], i))[:5]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == want
    assert [(r.query_id, r["rank"], r.doc_id, r.score) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(r.query_id, r["rank"], r.doc_id, r.score) for r in sorted(in_rounds(semantic, df), key=lambda r: (r.query_id, r["rank"]))]
    odd = df.unionByName(spark.createDataFrame([(1000, None), (1001, [1.0]), (1002, [9.0] * 9), (1003, [None] * 8), (1004, [float("nan")] * 8)], "doc_id long, embedding array<float>"))
    again = semantic.cosine_top(odd.where("doc_id % 50 = 3 or doc_id > 999").withColumnRenamed("doc_id", "query_id"), odd, 5).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert semantic.cosine_top(df.limit(0).withColumnRenamed("doc_id", "query_id"), df, 5).count() == 0
    assert semantic.valid(spark.createDataFrame([(1, [1.0]), (2, None), (3, [1.0, 0.0])], "doc_id long, embedding array<float>"), 2).count() == 1


def test_snippets():
    assert highlight("Sorting, sorted & sort_it", ["sorting"]) == "<mark>Sorting</mark>, <mark>sorted</mark> & sort_it"
    assert highlight("x", []) == "x" and highlight(None, ["a"]) == "" and snippet("", ["a"]) == ""
    assert snippet("  A  short\ntext ", ["short"]) == "A <mark>short</mark> text"
    words = [f"w{i}" for i in range(200)]
    words[100] = "memory"
    got = snippet(" ".join(words), ["memory"])
    assert got.startswith("... w66 ") and got.endswith(" ...") and "<mark>memory</mark>" in got and len(got.split()) == 37


def test_engine(spark, docs):
    links = spark.createDataFrame(LINKS, SCHEMAS["links"])
    e = Engine(docs, links)
    first = e.search("sorting")
    assert [r["doc_id"] for r in first["results"]] == [i for i, _ in python_bm25("sorting")] and not first["cache_hit"]
    assert "<mark>" in first["results"][0]["snippet"] and e.search(" SORTING ")["cache_hit"]
    assert e.spellcheck("memry") == "memory" and e.spellcheck("memory") is None
    assert e.autocomplete("sort")[0] == "SORTING"  # the form that was searched last
    hybrid = e.search("sorting python", ranking="hybrid")["results"]
    assert {r["doc_id"] for r in hybrid} == {1, 2, 3, 4} and all(0 < r["score"] <= 1 for r in hybrid)
    assert [r["doc_id"] for r in e.search("sorting site:b.example", ranking="hybrid")["results"]][0] == 3
    assert e.build_embeddings()["embedded_count"] == 0
    top = e.recompute_pagerank()
    assert top[0][0] == "https://b.example/3" and abs(sum(r for _, r in top) - 1) < 1e-9
    a = e.analytics()
    assert a["total_searches"] == 4 and a["unique_queries"] == 3 and a["top_queries"][0]["query"] == "sorting"
    assert e.stats()["total_links"] == 2
    e.record_click(first["query_id"], 1, 1, "https://a.example/1")
    assert [(r.query_id, r.doc_id) for r in e.clicks.collect()] == [(first["query_id"], 1)]
    with pytest.raises(ValueError):
        e.search("", page=0)
    again = Engine(docs, links, folder=e.folder)  # the stored logs outlive the object
    assert again.log.count() == 4 and again.clicks.count() == 1 and again.search("python")["query_id"] == 5
    assert e.autocomplete("memo") == [] and e.search("memory") and e.autocomplete("memo") == ["memory"]


def test_crawl_and_seed(spark, docs):
    page = lambda title, body, *to: f"<html><head><title>{title}</title></head><body><p>{body}</p>" + "".join(f'<a href="{t}">{t}</a>' for t in to) + "</body></html>"
    pages = [
        ("https://n.example/", page("New start", "fresh words on graphs", "/a", "/private/x", "https://b.example/2", "/gone"), 200, "text/html"),
        ("https://n.example/a", page("Page a", "more on graphs", "/", "/img"), 200, None),
        ("https://n.example/private/x", page("Secret", "hidden"), 200, "text/html"),
        ("https://n.example/img", "binary", 200, "image/png"),
        ("https://n.example/err", page("Error", "x"), 500, "text/html"),
        ("https://b.example/2", page("", "operating systems anew"), 200, "text/html"),
        ("https://n.example/a", page("Page a", "more on graphs", "/", "/img"), 200, None),
        (None, "x", 200, None),
    ]
    fetched = spark.createDataFrame(pages, "url string, html string, status int, content_type string")
    rules = spark.createDataFrame([("https://n.example", "*", 0, False, "/private")], "domain_key string, agent string, ord int, allow boolean, path_prefix string")
    e = Engine(docs, spark.createDataFrame(LINKS, SCHEMAS["links"]))
    assert e.crawl(["https://n.example/", " "], fetched, rules) == {"crawled": 3, "denied": 1, "failed": 1, "empty": 1}
    rows = {r.url: r for r in e.docs.collect()}
    assert len(rows) == 6 and rows["https://b.example/2"].doc_id == 2 and rows["https://b.example/2"].title == "Operating systems" and rows["https://b.example/2"].body == "operating systems anew"
    assert {rows["https://n.example/"].doc_id, rows["https://n.example/a"].doc_id} == {5, 6} and rows["https://n.example/a"].domain == "n.example"
    assert {r["url"] for r in e.search("graphs")["results"]} == {"https://n.example/", "https://n.example/a"}
    assert e.links.where("source_url = 'https://n.example/a'").count() == 2

    first = spark.createDataFrame([("https://x.example/1", "One", "x.example", None, "first words here", 9.9), ("https://x.example/2", "Two", None, "", None, 0.1), ("https://x.example/1", "Zwei", "x.example", None, "b", 0.0), (" ", "t", "", "", "", 0.0)], "url string, title string, domain string, description string, body string, pagerank_score double")
    s = Engine.seeded(first, spark.createDataFrame([("https://x.example/1", "https://x.example/2", "a"), ("https://x.example/1", "https://x.example/2", None)], "source_url string, target_url string, anchor_text string"))
    got = {r.doc_id: (r.url, r.title, r.word_count, round(r.pagerank_score, 6)) for r in s.docs.collect()}
    assert got == {1: ("https://x.example/1", "One", 3, 0.0), 2: ("https://x.example/2", "Two", 0, 1.0)} and s.links.count() == 1
