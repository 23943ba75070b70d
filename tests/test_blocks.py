import random

import pytest
from pyspark.sql import functions as F

from siftline.operators import blocks, index, search
from siftline.sources.tables import SCHEMAS

WORDS = ["graph", "sort", "tree", "queue", "memory", "paging", "kernel", "query", "index", "token", "stack", "cache"]


@pytest.fixture(scope="module")
def made(spark):
    blocks.LEAST_PAGES = 70  # several blocks of few pages
    rng = random.Random(4)
    rows = []
    for i in range(260):
        text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 40)))
        title = rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(3)).title()])
        rows.append((i, f"https://h{i}.example/", title, None, text or None, rng.choice([None, "a_b.example", "axb.example", "C%D.example"]), None, None, rng.choice([None, 0.0, 0.7]), None))
    rows += rows[:6]
    docs = index.pages(spark.createDataFrame(rows, SCHEMAS["docs"])).cache()
    postings, lengths = index.postings(docs).cache(), index.doc_lengths(docs).cache()
    return docs, postings, lengths, blocks.block_index(search.page_facts(docs, lengths), postings).cache()


def asked(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 4))) for _ in range(40)]
    texts += ["sort AND tree AND queue", "sort -tree", "sort site:a_b", "cache site:C%D", "nothing", "", None, "sort sort sort", "graph AND nothing", "the of"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


@pytest.mark.parametrize(
    "options", [{}, {"method": "tfidf"}, {"boosts": False, "limit": 3}, {"all_terms": True, "limit": 5}, {"exclude": True, "limit": 7}, {"domain": "a_b", "limit": 4}, {"domain": "nowhere"}]
)
def test_blocks_give_what_all_pairs_give(spark, made, options):
    docs, postings, lengths, index_rows = made
    options = {"limit": 10} | options
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = rows(search.search(asked(spark), docs, postings, lengths, **options))
    assert rows(search.search(asked(spark), docs, postings, lengths, blocks=index_rows, **options)) == want
    assert want or options.get("domain") == "nowhere"


def test_written_index_and_rounds(spark, made, tmp_path, monkeypatch):
    docs, postings, lengths, index_rows = made
    blocks.write(index_rows, f"{tmp_path}/index")
    stored = blocks.read(spark, f"{tmp_path}/index")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    want = rows(search.search(asked(spark), docs, postings, lengths, limit=10))
    monkeypatch.setattr(blocks, "QUERY_BATCH", 9)  # several rounds
    assert rows(search.search(asked(spark), docs, postings, lengths, blocks=stored, limit=10)) == want
    assert {r.term: r.df for r in blocks.document_frequency(stored).collect()} == {r.term: r.df for r in index.doc_frequency(postings).collect()}
    assert search.search(asked(spark).limit(0), docs, postings, lengths, blocks=stored, limit=10).count() == 0
    empty = blocks.block_index(search.page_facts(docs.limit(0), lengths.limit(0)), postings.limit(0))
    assert search.search(asked(spark), docs.limit(0), postings.limit(0), lengths.limit(0), blocks=empty, limit=10).count() == 0


def test_blocks_that_cannot_matter_are_skipped():
    options = {"method": "bm25", "k1": 1.5, "b": 0.75, "title": 0.5, "authority": 0.3, "boosts": True, "limit": 2}
    scorer = blocks._Scorer([(7, [(0, 1)], ["sort"], None, False, [])], {"sort": 4}, (10, 5.0), options)
    import numpy as np

    page = lambda ids, title: {"doc_id": ids, "doc_len": [5] * len(ids), "pr": [0.0] * len(ids), "title": [title] * len(ids), "domain": [None] * len(ids)}
    first = list(scorer.block(page([1, 2], "Sorting"), ["sort"], np.array([2]), np.array([1, 2]), np.array([9, 9])))
    assert first[0][1].tolist() == [1, 2]
    assert list(scorer.block(page([3, 4], "other"), ["sort"], np.array([2]), np.array([3, 4]), np.array([1, 1]))) == []
    assert list(scorer.block(page([5], "sort"), ["sort"], np.array([1]), np.array([5]), np.array([9])))[0][1].tolist() == [5]


@pytest.mark.parametrize("common", [0.0, 0.2, 0.3, 2.0])
@pytest.mark.parametrize("options", [{}, {"all_terms": True, "limit": 4}, {"exclude": True, "limit": 7}, {"method": "tfidf", "boosts": False}])
def test_common_and_own_terms_give_what_all_pairs_give(spark, made, monkeypatch, options, common):
    docs, postings, lengths, index_rows = made
    texts = ["sort AND tree AND queue", "tree sort AND queue", "queue  sort AND Tree", "sort -tree", "sort -tree graph", "cache site:C%D", "cache tok site:a_b", "sort sort tok", "graph AND nothing", "ach sort", "index or or"]
    texts += ["graph sort", "sort graph", "memory sort", "Sort GRAPH", "kernel graph sort", "sort", "graph", "paging paging", "stack graph -sort", "stack AND graph", "nothing graph", "nothing"]
    asked_ = spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")
    rows = lambda df: sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in df.collect())
    options = {"limit": 10} | options
    want = rows(search.search(asked_, docs, postings, lengths, **options))
    monkeypatch.setattr(blocks, "COMMON", common)
    assert rows(search.search(asked_, docs, postings, lengths, blocks=index_rows, **options)) == want and want


def _scorings(queries):
    """What queries of (own terms, words, and whether all must be held) are scored for all together, and what is left of each."""
    groups, place, rest, rest_of = blocks._split([(k, own, words, None, all_of, []) for k, (own, words, all_of) in enumerate(queries)], True)
    return [(g[1], g[2]) for g in groups], place, [q[-2:] for q in rest], rest_of


def test_common_terms_are_scored_once_for_all_queries(monkeypatch):
    monkeypatch.setattr(blocks, "COMMON", 0.3)
    exam = [([(0, 1), (k, 1)], ["exam", f"w{k}"], False) for k in range(1, 9)]
    groups, place, rest, rest_of = _scorings([*exam, ([(0, 1)], ["exam"], False), ([(0, 1), (9, 1)], ["exam", "w9"], True)])
    assert groups == [([(0, 1)], ["exam"])]
    # a query with AND has no page that lacks its own term
    assert place == [0] * 9 + [-1]
    assert rest == [((k,), (f"w{k}",)) for k in range(1, 10)] and rest_of == [*range(8), 9]


def test_queries_share_common_terms_only_with_the_same_exclusions(monkeypatch):
    monkeypatch.setattr(blocks, "COMMON", 0.3)
    queries = [(k, [(0, 1), (k, 1)], ["exam", f"w{k}"], None, False, [20] if k > 4 else []) for k in range(1, 9)]
    groups, place, rest, _ = blocks._split(queries, True)
    assert [g[1:] for g in groups] == [([(0, 1)], ["exam"], None, False, []), ([(0, 1)], ["exam"], None, False, [20])]
    assert place == [0] * 4 + [1] * 4 and [q[5] for q in rest] == [[]] * 4 + [[20]] * 4


def test_own_pages_below_those_by_common_terms_stay_in_the_block():
    import numpy as np

    options = {"method": "bm25", "k1": 1.5, "b": 0.75, "title": 0.5, "authority": 0.3, "boosts": True, "limit": 2}
    pages = {"doc_id": [1, 2, 3], "doc_len": [5] * 3, "pr": [0.0] * 3, "title": ["An exam", "Resorting", ""], "domain": [None] * 3}
    lists = (["exam", "sort"], np.array([3, 1]), np.array([1, 2, 3, 3]), np.array([1, 1, 1, 1]))
    query = (7, [(0, 1), (1, 1)], ["exam", "sort"], None, False, [], (1,), ("sort",))
    found = lambda floor: [x[1].tolist() for x in blocks._Rest([query], {"exam": 4, "sort": 1}, (10, 5.0), options, np.array([floor])).block(pages, *lists)]
    # page 2 has the word within its title only, page 1 has but the common term
    assert found(-np.inf) == [[2, 3]]
    assert found(2.5) == [[3]] and found(99.0) == []
