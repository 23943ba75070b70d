import random
import uuid
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from siftline.functions.fold import fold
from siftline.llm import fusion
from siftline.llm import term_counts as tc
from siftline.storage import Folder, shared_dir


def entries(spark, rows):
    return spark.createDataFrame(rows, "term string, record long, n long")


def recount(rows):
    occurrences, records = defaultdict(int), defaultdict(int)
    for t, _, n in rows:
        occurrences[t] += n
        records[t] += 1
    return {t: (occurrences[t], records[t]) for t in records}


def test_deltas_equal_a_recount(spark):
    rng = random.Random(2)
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    store = tc.TermCounts(spark, path, buckets=4)
    held: dict[int, list] = {}
    for _ in range(4):
        before, after = [], []
        for r in {rng.randrange(30) for _ in range(12)}:
            before += held.pop(r, [])
            if rng.random() < 0.7:  # added or changed, else deleted
                held[r] = [(t, r, rng.randint(1, 5)) for t in {rng.choice("abcdefgh") for _ in range(4)}]
                after += held[r]
        store.apply(entries(spark, before), entries(spark, after))
        now = {r.term: (r.occurrences, r.records) for r in store.counts().collect()}
        assert now == recount([x for own in held.values() for x in own])
        assert store.total == len(held)
    again = tc.TermCounts.open(spark, path)
    assert again.total == store.total and again.counts().count() == store.counts().count()
    store.apply(entries(spark, [x for own in held.values() for x in own]), None)
    assert store.counts().count() == 0 and tc.TermCounts.open(spark, path).counts().count() == 0


def test_only_touched_partitions_are_written_again(spark):
    store = tc.TermCounts(spark, f"{shared_dir(spark)}/test-{uuid.uuid4().hex}", buckets=8)
    store.apply(None, entries(spark, [(w, i, 1) for i, w in enumerate("abcdefghijklmnop")]))
    old = dict(store.manifest)
    store.apply(None, entries(spark, [("a", 99, 1)]))
    assert sum(old[b] != f for b, f in store.manifest.items()) == 1


def test_a_store_that_grows_has_more_partitions(spark):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    store = tc.TermCounts(spark, path, buckets=2, per_bucket=10)
    rows = [(f"t{i % 97}", i, 1 + i % 3) for i in range(300)]
    for lo in range(0, 300, 60):
        store.apply(None, entries(spark, rows[lo : lo + 60]))
        again = tc.TermCounts.open(spark, path, per_bucket=10)
        assert {r.term: (r.occurrences, r.records) for r in again.counts().collect()} == recount(rows[: lo + 60])
        assert again.rows == store.rows and again.total == lo + 60
    assert store.buckets == 16 and max(store.rows.values()) <= 20
    last_two = spark.read.schema("folder string").parquet(f"{path}/manifests/4", f"{path}/manifests/5").collect()
    kept = {r.folder.rpartition("/")[0].rpartition("/")[2] for r in last_two}
    assert {n for n in Folder(spark, path).names() if n.startswith("counts-")} == kept and sum(n.isdigit() for n in Folder(spark, f"{path}/manifests").names()) == 2


def test_of_two_writers_one_fails(spark):
    path = f"{shared_dir(spark)}/test-{uuid.uuid4().hex}"
    a = tc.TermCounts(spark, path, buckets=2)
    a.apply(None, entries(spark, [("x", 1, 1)]))
    b = tc.TermCounts.open(spark, path)
    a.apply(None, entries(spark, [("y", 2, 1)]))
    with pytest.raises(RuntimeError):
        b.apply(None, entries(spark, [("z", 3, 1)]))
    assert {r.term for r in tc.TermCounts.open(spark, path).counts().collect()} == {"x", "y"}
    assert Folder(spark, f"{path}/manifests").claim("3")  # by a writer that then ends
    with pytest.raises(RuntimeError):
        a.apply(None, entries(spark, [("z", 3, 1)]))
    c = tc.TermCounts.open(spark, path, abandon=True)
    c.apply(None, entries(spark, [("z", 3, 1)]))
    assert c.version == 3 and c.total == 3


def test_entries_and_marks(spark):
    rows = [
        ("Café", 1, 9, [1, 2]), ("cafe", 1, 2, [1, 2]), ("cafe ", 2, 1, [4]), ("cafe", 3, 3, None), (None, 1, 1, [1]), ("  ", 4, 1, [1]), ("x", None, 1, [1]), ("हि", 5, 1, [1]), ("y", 1, 1, [7]),
    ]
    p = spark.createDataFrame(rows, "term string, doc_id long, term_frequency int, positions array<int>").withColumn("n", F.lit("clash"))
    got = {(r.term, r.record): r.n for r in tc.term_entries(p).collect()}
    blank = {k: n for k, n in got.items() if k[0] is None}
    assert blank == {(None, 1): 0, (None, 4): 0, (None, 5): 0}  # of records with null and blank terms
    got = {k: n for k, n in got.items() if k[0] is not None}
    assert got == {("cafe", 1): 2, ("cafe", 2): 1, ("cafe", 3): 3, ("y", 1): 1}
    counts = spark.createDataFrame([("cafe", 6, 3), ("y", 1, 2)], "term string, occurrences long, records long")
    assert {(r.term, r.mark) for r in tc.marked(counts, 5).collect()} == {("cafe", "common"), ("y", "rare"), ("y", "common")}
    assert {(r.term, r.mark) for r in tc.marked(counts, 100).collect()} == {("y", "rare")}


def brute_places(values):
    have = [v for v in values if v is not None and v == v]
    return [1 + sum(w > v for w in have) if v is not None and v == v else len(have) + 1 for v in values]


def test_fusion_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, float("nan"), 1.0, 2.0, 3.5]), rng.choice([None, 10.0, 20.0, 1e9])) for g in (1, 2, None) for i in range(25)]
    rows += rows[:5]  # repeated
    df = spark.createDataFrame(rows, "q long, d long, a double, b double").withColumn("rank", F.lit("clash"))
    for k in (60, None):
        out = fusion.fuse(df, "q", "d", ["a", "b"], k=k).collect()
        assert len(out) == 75
        for g in (1, 2, None):
            own = sorted({r[1]: r for r in rows if r[0] == g}.values(), key=lambda r: r[1])
            places = list(zip(brute_places([r[2] for r in own]), brute_places([r[3] for r in own])))
            mine = sorted((r for r in out if r.q == g), key=lambda r: r.d)
            assert [tuple(r.places) for r in mine] == places
            order = sorted(mine, key=lambda r: (r.place_sum if k is None else 0, -r.fused, r.place_sum, r.d))
            assert k is None or all(abs(r.fused - sum(1 / (k + p) for p in r.places)) < 1e-12 for r in mine)
            assert [r.d for r in sorted(mine, key=lambda r: r["rank"])] == [r.d for r in order]
        best = fusion.fuse(df, "q", "d", ["a", "b"], k=k, best_only=True).collect()
        assert sorted(map(str, best)) == sorted(str(r) for r in out if r["rank"] == 1)
    assert fusion.fuse(df.limit(0), "q", "d", ["a", "b"], k=None).count() == 0
