import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.llm import packing
from siftline.llm.encoding import TOKENIZERS


def histogram(sizes, capacity):
    out = np.zeros(capacity + 1, np.int64)
    np.add.at(out, sizes, 1)
    return out


def check(fills, counts, capacity):
    used = np.zeros(capacity + 1, np.int64)
    for f in fills:
        assert f.times > 0 and sum(s * n for s, n in f.items) <= capacity
        for s, n in f.items:
            used[s] += n * f.times
    assert (used[1:] == counts[1:]).all()
    return sum(f.times for f in fills)


def fewest(sizes, capacity):
    """Exhaustive."""
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for r in range(len(rooms)):
            if rooms[r] >= sizes[k]:
                go(k + 1, [*rooms[:r], rooms[r] - sizes[k], *rooms[r + 1 :]])
        go(k + 1, [*rooms, capacity - sizes[k]])

    sizes = sorted(sizes, reverse=True)
    go(0, [])
    return best[0]


@settings(max_examples=60, deadline=None)
@given(st.integers(5, 30).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=9))))
def test_plans_hold_all_items_and_bounds_hold(case):
    capacity, sizes = case
    counts = histogram(sizes, capacity)
    least = fewest(sizes, capacity)
    assert packing.lower_bound(counts, capacity) <= least
    for nodes in (None, packing.NODES):
        found = packing.plan(counts, capacity, nodes)
        assert check(found.fills, counts, capacity) == found.containers == least
        assert found.optimal
    check(packing.best_fit(counts, capacity), counts, capacity)
    check(packing.complete(counts, capacity), counts, capacity)
    check(packing.improved(packing.best_fit(counts, capacity), capacity, 0, 2000)[0], counts, capacity)


def test_many_items_come_near_the_bound():
    rng = np.random.default_rng(1)
    sizes = np.clip(rng.lognormal(5, 0.8, 20000).astype(int), 1, 512)
    counts = histogram(sizes, 512)
    bound, found = packing.lower_bound(counts, 512), packing.plan(counts, 512)
    assert check(found.fills, counts, 512) <= 1.001 * bound and found.optimal == (found.containers == bound)


def test_search_goes_back_where_greedy_fails():
    # 8 + 5 is the fullest filling beside 8, but the others then need one container more
    sizes, capacity = [9, 9, 6, 6, 6, 4, 4, 4, 3, 3, 3, 3], 15
    counts = histogram(sizes, capacity)
    assert packing.plan(counts, capacity, None).containers == fewest(sizes, capacity) == 4
    rng = np.random.default_rng(5)
    greedy = total = 0
    for _ in range(150):
        sizes = rng.integers(20, 60, 12).tolist()
        counts = histogram(sizes, 100)
        exact = packing.plan(counts, 100, None)
        assert exact.optimal and check(exact.fills, counts, 100) == exact.containers
        greedy += min(check(packing.complete(counts, 100, price=p), counts, 100) for p in packing.PRICES)
        total += exact.containers
    assert total <= greedy


def test_windows_improve_a_plan():
    rng = np.random.default_rng(3)
    sizes = np.clip(rng.lognormal(5, 0.6, 3000).astype(int), 40, 512)
    counts = histogram(sizes, 512)
    first = packing.best_fit(counts, 512)
    better, left = packing.improved(first, 512, packing.lower_bound(counts, 512), 200_000)
    assert check(better, counts, 512) < sum(f.times for f in first) and left < 200_000
    doubled, _ = packing.improved(packing.best_fit(counts * 1000, 512), 512, packing.lower_bound(counts * 1000, 512), 200_000)
    check(doubled, counts * 1000, 512)


def test_containers_of_thousands_of_items():
    # more items in a container than Python calls may be nested
    counts = histogram([3] * 4000 + [5] * 3000 + [7] * 10, 8192)
    for price in packing.PRICES:
        check(packing.complete(counts, 8192, price=price), counts, 8192)
    search = packing.BranchAndBound({3: 4000, 5: 3000, 7: 10}, 8192, None)
    found = search.solve(4)
    assert sorted(s for own in found for s in own) == [3] * 4000 + [5] * 3000 + [7] * 10
    assert all(sum(own) <= 8192 for own in found) and len(found) == packing.lower_bound(counts, 8192) == 4
    many = histogram([2000, 1900, 150, 100, 31, 30, 24, 7, 1], 2048) * 3_000_000
    found = packing.plan(many, 2048)
    assert check(found.fills, many, 2048) == found.containers


def test_a_search_many_containers_deep(monkeypatch):
    rng = np.random.default_rng(6)
    for hand in (1, 2, 1000):
        monkeypatch.setattr(packing, "AT_HAND", hand)
        for _ in range(40):
            sizes = rng.integers(20, 60, 11).tolist() + [100] * 5 + [81] * 3
            found = packing.plan(histogram(sizes, 100), 100, None)
            assert found.optimal and check(found.fills, histogram(sizes, 100), 100) == 8 + fewest(sizes[:11], 100)
            assert sorted(k for f in found.fills for k in range(f.base, f.base + f.times)) == list(range(found.containers))


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.json"), reason="no tokenizer files")
def test_table(spark):
    rows = [(i, "word " * (i % 37)) for i in range(300)] + [(900, None), (901, ""), (902, "word " * 1000), (5, "word " * 5), (None, "no id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as container").repartition(3)
    out = packing.pack(df, "doc_id", "text", {"a": 16, "b": 64}).toPandas()
    assert out.optimal.all()
    texts = dict(rows)
    for name, capacity in (("a", 16), ("b", 64)):
        own = out[out.capacity_name == name]
        assert own.doc_id.nunique(dropna=False) == len(texts)
        loads = own.groupby("container").n_tokens.sum()
        assert loads.max() <= capacity and sorted(loads.index) == list(range(len(loads)))
        assert len(own[own.doc_id == 900]) == 1 and own[own.doc_id == 900].n_tokens.iloc[0] == 0
        long = own[own.doc_id == 902].sort_values("piece_no")
        assert (long.first_token.to_numpy() == np.arange(len(long)) * capacity).all() and (long.n_tokens.iloc[:-1] == capacity).all()
    assert packing.pack(df.limit(0), "doc_id", "text", {"a": 16}).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, "doc_id", "text", {"none": 0})
