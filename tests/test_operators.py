import random

from pyspark.sql import functions as F

from siftline.operators import analytics, graph, spell, suggest
from siftline.operators.cache import ResultCache, cache_key
from siftline.operators.components import connected_components
from siftline.operators.ranks import competition_places, number
from siftline.sources import html, tables
from siftline.storage import Folder, materialize, scope, shared_dir, without_copies
from siftline.streaming import logs


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def links(spark, edges):
    return spark.createDataFrame(list(edges), "source_url string, target_url string")


def test_pagerank_golden(spark):
    e = links(spark, [("A", "B"), ("A", "C"), ("B", "C"), ("C", "A"), ("A", "B"), ("A", "A"), ("A", "Z")])
    got = {r.node: r.rank for r in graph.pagerank(nodes(spark, "ABCD"), e).collect()}
    for n, want in dict(A=0.3693233223, B=0.2045815282, C=0.3784761018, D=0.0476190476).items():
        assert abs(got[n] - want) < 1e-8
    kept = Folder(spark, shared_dir(spark)).names()
    assert sum(n.startswith("ranks_") for n in kept) == 1 and not any(n.startswith(("graph_edges", "graph-edges")) for n in kept)
    ring = graph.pagerank(nodes(spark, "XYZ"), links(spark, map(tuple, ["XY", "YZ", "ZX"]))).collect()
    assert all(abs(r.rank - 1 / 3) < 1e-12 and r.pagerank_score == 0 for r in ring)
    assert [r.rank for r in graph.pagerank(nodes(spark, "Q"), e).collect()] == [1.0] and graph.pagerank(nodes(spark, ""), e).count() == 0


def test_frontier_and_crawl(spark):
    e = links(spark, [("https://a/0", "https://a/1"), ("https://a/1", "https://b/2"), ("https://a/1", "https://a/0"), ("https://b/2", "https://a/3"), ("https://a/0", " ")])
    seeds = spark.createDataFrame([("https://a/0 ",), ("https://a/0",)], "url string")
    reach = lambda **o: {r.url: r.depth for r in graph.frontier(seeds, e, **o).collect()}
    assert reach() == {"https://a/0": 0, "https://a/1": 1, "https://b/2": 2, "https://a/3": 3}
    assert reach(max_depth=1) == {"https://a/0": 0, "https://a/1": 1} and set(reach(first_host="a")) == {"https://a/0", "https://a/1"}
    assert set(reach(first_host="a", hosts=("b",))) == set(reach())
    known = spark.createDataFrame([("https://a/0", True, 200, True), ("https://a/1", True, 200, True), ("https://b/2", True, 500, True)], "url string, allowed boolean, status int, has_text boolean")
    out = {r.url: (r.outcome, r.crawl_no) for r in graph.crawl(seeds, e, known).collect()}
    assert out == {"https://a/0": ("crawled", 1), "https://a/1": ("crawled", 2), "https://b/2": ("failed", None)}
    limited = {r.url: r.outcome for r in graph.crawl(seeds, e, known, max_pages=1).collect()}
    assert limited["https://a/1"] == "queued"


def test_components_against_union_find(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5050)] + [(None, 1), (3, 3)]
    parent: dict[int, int] = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_places_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 1.0, 2.0, 5.0])) for _ in range(400)]
    got = competition_places(spark.createDataFrame(rows, "k string, v double").withColumn("r", F.lit(1)), ["k"], [number("v")], "place").collect()
    assert len(got) == 400
    for r in got:
        own = [v for k, v in rows if k == r.k and v is not None and v == v]
        ok = r.v is not None and r.v == r.v
        assert r.place == 1 + (sum(v > r.v for v in own) if ok else len(own))


def test_places_over_ranges_that_cut_groups_and_ties(spark):
    rng = random.Random(9)
    rows = [("a", i, rng.choice([1.0, 2.0]) if i % 3 else None, i % 7) for i in range(3000)] + [("b", i, float(i), 0) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i long, v double, w long").repartition(7)
    got = competition_places(df, ["k"], [F.col("v"), F.col("w")], "place", descending=False).collect()
    assert len(got) == len(rows)
    for key in "ab":
        own = sorted((r.v is None, r.v or 0, r.w) for r in got if r.k == key)
        first = {}
        for n, x in enumerate(own, 1):
            first.setdefault(x, n)
        assert all(r.place == first[r.v is None, r.v or 0, r.w] for r in got if r.k == key)
    assert {r.place for r in competition_places(df.where("k = 'b'"), [], [F.col("i")], "place").collect()} == set(range(1, 41))
    assert competition_places(df.limit(0), ["k"], [F.col("v")], "place").count() == 0


def test_scopes_remove_what_is_made_in_them(spark):
    outside = materialize(spark.range(5), "scoped")
    with scope():
        inside = materialize(spark.range(3), "scoped")
        assert inside.count() == 3
    names = Folder(spark, shared_dir(spark)).names()
    assert outside.written_to.rpartition("/")[2] in names and inside.written_to.rpartition("/")[2] not in names


def test_without_copies(spark):
    rows = [(1, "a"), (1, "a"), (2, None), (None, "x"), (None, "x")]
    assert sorted(map(str, without_copies(spark.createDataFrame(rows, "id long, t string"), "id").collect())) == sorted(map(str, spark.createDataFrame(rows, "id long, t string").distinct().collect()))


def test_suggestions(spark):
    log = spark.createDataFrame([(1, "Machine learning", 3), (2, "machine Learning ", 1), (3, "none", 0), (4, None, 1)], "id long, query string, results_count int")
    docs = spark.createDataFrame([(1, "Machine rooms of old"), (2, ""), (3, None)], "doc_id long, title string")
    known = suggest.suggestions(log, docs, seeds=("machine shop",))
    got = {r.key: (r.phrase, r.weight) for r in known.collect()}
    assert got == {
        "machine learning": ("machine Learning", 10), "machine rooms of old": ("Machine rooms of old", 2), "machine rooms of": ("Machine rooms of", 1),
        "rooms of old": ("rooms of old", 1), "of old": ("of old", 1), "machine shop": ("machine shop", 3),
    }
    ask = lambda *p: [(r.prefix, r.phrase) for r in suggest.autocomplete(known, spark.createDataFrame([(x,) for x in p], "prefix string"), limit=2).orderBy("prefix", "rank").collect()]
    assert ask("MACH", "", "zzz") == [("MACH", "machine Learning"), ("MACH", "machine shop")] and len(ask(" ")) == 2
    more = suggest.add_queries(known, spark.createDataFrame([("machine shop", 1), ("brand new", 2)], "query string, at long"))
    assert {r.key: r.weight for r in more.collect()}["machine shop"] == 4


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_corrections_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6)))
    vocab = {word(): rng.randint(1, 3) for _ in range(60)}
    words = {word() for _ in range(80)}
    want = {}
    for w in words - set(vocab):
        if len(w) > 2 and (near := [(levenshtein(w, v), -f, v) for v, f in vocab.items() if levenshtein(w, v) <= 2]):
            want[w] = min(near)[2]
    v = spark.createDataFrame(list(vocab.items()), "term string, freq long")
    got = {r.word: r.correction for r in spell.correct_words(spark.createDataFrame([(w,) for w in words], "word string"), v).collect()}
    assert got == want
    pairs = spell.near_words(spark.createDataFrame([(w,) for w in words], "word string"), v).collect()
    assert {(r.word, r.term, r.d) for r in pairs} == {(w, x, levenshtein(w, x)) for w in words for x in vocab if levenshtein(w, x) <= 2} and len(pairs) == len({(r.word, r.term) for r in pairs})
    long = "abcdefghij" * 400
    odd = spark.createDataFrame([(long[:-1] + "z", 1), (long, 2), ("", 1), (None, 1)], "term string, freq long")
    got = spell.correct_words(spark.createDataFrame([(long[:2000] + long[2002:],), ("xy",), (None,), ("",)], "word string"), odd).collect()
    assert [(r.word == long[:2000] + long[2002:], r.correction == long) for r in got] == [(True, True)]
    assert spark.range(1).select(F.size(spell.places_of(F.lit(long), 2))).first()[0] <= 75
    v = spark.createDataFrame([("machine", 9), ("learning", 9)], "term string, freq long")
    q = spark.createDataFrame([(1, "machne learing"), (2, "machine"), (3, ""), (4, None)], "query_id long, query string")
    assert [(r.query_id, r.correction) for r in spell.did_you_mean(q, v).collect()] == [(1, "machine learning")]


def test_html():
    page = html.parse_page(
        "https://x.example/d/p?q=1#f",
        """<html><head><title> The  page </title><meta name="Twitter:Description" content=" about "><script>var a = "</p>";</script></head>
        <body><nav><a href="/home">Home</a></nav><h1>Head</h1><p>One <b>two</b></p><a href="q;v=1?k=2#z">link <i>text</i></a><a href="mailto:x">m</a><a href="ftp://f/x">f</a><br/>three<footer>end</footer></body></html>""",
    )
    assert page["title"] == "The  page" and page["description"] == "about" and page["body_text"] == "The page Head One two link text m f three" and page["word_count"] == 10
    assert page["links"] == [{"target_url": "https://x.example/home", "anchor_text": "Home"}, {"target_url": "https://x.example/d/q?k=2", "anchor_text": "link text"}]
    assert html.parse_page(None, None)["body_text"] == "" and html.parse_page("u", "<h1>Only</h1>")["title"] == "Only"


def test_sources(spark, tmp_path):
    pages = spark.createDataFrame([("u1", "<p>x", 200, None), ("u2", None, 200, None), ("u3", "x", 404, None), ("u4", "x", 200, "image/png")], "url string, html string, status int, content_type string")
    assert [r.url for r in html.fetched(pages).collect()] == ["u1"]
    rules = spark.createDataFrame([("https://a.example", "*", 0, False, "/x"), ("https://a.example", "siftline", 1, True, "/x/y"), ("https://a.example", "siftline", 2, False, "/x")], "domain_key string, agent string, ord int, allow boolean, path_prefix string")
    urls = spark.createDataFrame([(u,) for u in ("https://a.example/x/y", "https://a.example/x?1", "https://a.example", "https://b.example/x")], "url string")
    assert {r.url: r.allowed for r in html.allowed(urls, rules).collect()} == {"https://a.example/x/y": True, "https://a.example/x?1": False, "https://a.example": True, "https://b.example/x": True}
    folder = str(tmp_path)
    tables.create(spark, folder)
    tables.append(spark.createDataFrame([(1, 2, 3, 1, "u", None)], tables.SCHEMAS["click_log"]), folder, "click_log")
    assert tables.read(spark, folder, "click_log").count() == 1 and tables.read(spark, folder, "docs").count() == 0


def test_jdbc_round_trip(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, query string")
    try:
        tables.to_jdbc(rows, url, "log", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception as e:
        if "ClassNotFound" in str(e) or "No suitable driver" in str(e):
            __import__("pytest").skip("no database on the class path")
        raise
    tables.to_jdbc(rows, url, "log", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    got = tables.jdbc(spark, url, "log", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(2 * ["(1, 'a')", "(2, None)"])


def test_analytics(spark):
    rows = [(1, "A b", None, 2, 1, 10.0, True, "bm25", None), (2, "a B", "a b", 0, 1, None, False, "bm25", None), (1, "A b", None, 2, 1, 10.0, True, "bm25", None)]
    log = analytics.entries(spark.createDataFrame(rows, tables.SCHEMAS["query_log"]))
    one = spark.createDataFrame([("t",), ("t",)], "term string")
    s = analytics.summary(log, one, one).first()
    assert (s.total_searches, s.unique_queries, s.avg_response_time_ms, s.zero_result_rate_pct, s.cache_hit_rate_pct, s.total_documents, s.total_indexed_terms) == (2, 1, 10.0, 50.0, 50.0, 2, 1)
    empty = analytics.summary(log.limit(0), one.limit(0), one.limit(0)).first()
    assert (empty.total_searches, empty.avg_response_time_ms, empty.zero_result_rate_pct) == (0, 0.0, 0.0)
    clicks = spark.createDataFrame([(1, 5)], "query_id long, doc_id long")
    assert [(r.query, r.ctr) for r in analytics.click_rates(log, clicks).collect()] == [("a b", 0.5)]


def test_cache():
    now = [0.0]
    c = ResultCache(2, 10, clock=lambda: now[0])
    c.put("a", 1)
    c.put("b", 2)
    assert c.get("a") == 1
    c.put("c", 3)  # b goes
    assert c.get("b") is None and c.get("a") == 1
    now[0] = 11
    assert c.get("a") is None and c.stats() == {"size": 1, "max_size": 2, "hits": 2, "misses": 2, "hit_rate_pct": 50.0}
    c.clear()
    assert c.stats()["size"] == 0 and cache_key(" Q ", 2, 5, "tfidf", "D.x") == "q|p=2|n=5|r=tfidf|d=d.x"


def test_streams(spark, tmp_path):
    from datetime import datetime

    at = lambda day, h=0: datetime(2025, 3, day, h)
    rows = [(1, "A ", None, 2, 1, 1.0, True, "bm25", at(1)), (1, "A ", None, 2, 1, 1.0, True, "bm25", at(1)), (2, "a", "a", 4, 1, 1.0, True, "bm25", at(1, 5)), (3, "b", "b", 0, 1, 1.0, True, "bm25", at(9))]
    spark.createDataFrame(rows, tables.SCHEMAS["query_log"]).write.parquet(f"{tmp_path}/log")
    for name, stream, mode in (("freq", logs.frequent_queries(logs.read_log(spark, f"{tmp_path}/log")), "append"), ("sugg", logs.suggestion_weights(logs.read_log(spark, f"{tmp_path}/log")), "complete")):
        q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
        q.processAllAvailable()
        q.stop()
    assert [(r.query, r["count"], r.avg_results) for r in spark.table("freq").collect()] == [("a", 2, 3.0)]
    assert {r.key: r.weight for r in spark.table("sugg").collect()}["a"] == 3


def test_whole_bodies_are_encoded(spark):
    from siftline.operators import semantic

    docs = spark.createDataFrame([(1, "t", None, "word " * 600 + "sorting"), (2, "t", "", "word " * 600), (3, None, None, None)], "doc_id long, title string, description string, body string")
    whole = {r.doc_id: r.embedding for r in semantic.build(docs).collect()}
    assert len(whole) == 3 and whole[1] != whole[2]
    cut = {r.doc_id: r.embedding for r in semantic.build(docs, body_chars=2000).collect()}
    assert cut[1] == cut[2] and len(cut) == 3
