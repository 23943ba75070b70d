import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from siftline.functions.fold import tokenize
from siftline.llm import near_duplicates as nd

WORDS = ["red", "blue", "one", "two", "node", "tree", "graph", "data", "sort", "map", "disk", "core", "run", "set", "key", "row"]


def collection(seed=1, n=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(n):
        base = [rng.choice(WORDS) + str(rng.randint(0, 9)) for _ in range(rng.randint(22, 70))]
        texts.append(base)
        for _ in range(rng.randint(0, 3)):
            t = list(base)
            for _ in range(rng.randint(0, 4)):
                at = rng.randrange(len(t))
                rng.choice([lambda: t.insert(at, "new"), lambda: t.pop(at), lambda: t.__setitem__(at, "other")])()
            texts.append(t)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def brute(rows, width, least, threshold):
    sets = {}
    for i, text in rows:
        t = tokenize(text)
        if i is not None and len(t) >= max(least, width):
            sets[i] = {tuple(t[k : k + width]) for k in range(len(t) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-12}


def test_pairs_are_those_of_brute_force(spark):
    rows = [*collection(), (1000, None), (1001, ""), (1002, "too short"), (None, "no id " * 30), (3, collection()[3][1])]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("sig", __import__("pyspark").sql.functions.lit("clash"))
    for threshold, width, least in ((0.6, 3, 20), (0.8, 5, 5), (1.0, 2, 2)):
        found = nd.near_duplicates(df, "id", "text", threshold=threshold, width=width, min_tokens=least)
        got = [(r.doc_a, r.doc_b) for r in nd.linked_pairs(found).collect()]
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, width, least, threshold)


def test_split_lists_give_the_same_pairs(spark):
    rows = collection(seed=11, n=50)
    shared = " ".join(f"same{k}" for k in range(60))
    rows += [(500 + i, f"{shared} own{i} tail{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    for hot in (3, 16):
        got = [(r.doc_a, r.doc_b) for r in nd.linked_pairs(nd.near_duplicates(df, "id", "text", threshold=0.6, width=3, min_tokens=20, hot=hot)).collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, 3, 20, 0.6)


def blobs_of(spark, sets, lengths, threshold, parts, hot):
    rows = [(k, nd.pack(s)) for k, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "sig long, grams binary")
    out = {}
    for r in nd.short_postings(df, lengths, threshold, parts, hot).collect():
        out.setdefault(r.part, []).append(r.blob)
    return out


def test_counts_of_short_lists_are_exact(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**40, 400).astype(np.uint64)
    sets = [np.unique(rng.choice(base, rng.integers(40, 120))) for _ in range(60)]
    sets += [np.unique(np.r_[s[5:], rng.integers(0, 2**40, 3).astype(np.uint64)]) for s in sets]
    count = np.zeros(2**20, np.int64)
    for s in sets:
        np.add.at(count, (s >> np.uint64(20)).astype(np.int64), 1)
    lengths = nd.Lengths(np.minimum(np.log2(count + 1.0) * 8, 255).astype(np.uint8), 20)
    for hot in (4, 8192):
        total = {}
        for blobs in blobs_of(spark, sets, lengths, 0.6, 5, hot).values():
            p = nd.Postings.read(blobs)
            for a, b, n in zip(*nd.merge_short_lists(p, 0.6)):
                key = (int(p.sig[a]), int(p.sig[b]))
                total[key] = total.get(key, 0) + int(n)
        size = np.array([len(s) for s in sets])
        d = nd.divide(np.concatenate(sets), size, lengths, 0.6)
        short = [set(d.gram[(d.owner == k) & (d.place < size[k] - d.long[k])].tolist()) for k in range(len(sets))]
        for a in range(len(sets)):
            for b in range(a + 1, len(sets)):
                x, y = set(sets[a].tolist()), set(sets[b].tolist())
                if len(x & y) >= 0.6 * len(x | y):
                    first, other = (a, y) if d.pivot[a] <= d.pivot[b] else (b, x)
                    assert total[a, b] == len(short[first] & other)
                    assert len(x & y) - total[a, b] <= d.long[first]


def test_hyphened_words_make_enough_tokens(spark):
    text = "-".join(f"w{k}" for k in range(3)) + " " + " ".join("".join(f"v{k}x{j}--" for k in range(30)) for j in range(2))
    rows = [(1, text), (2, text + " more")]
    got = nd.linked_pairs(nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", threshold=0.6, width=3, min_tokens=60)).collect()
    assert {(r.doc_a, r.doc_b) for r in got} == brute(rows, 3, 60, 0.6) == {(1, 2)}


def test_long_texts_have_longer_sketches(spark):
    rng = random.Random(5)
    base = [rng.choice(WORDS) + str(rng.randint(0, 400)) for _ in range(3000)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:2600])), (3, " ".join(rng.sample(base, len(base)))), (4, " ".join(base[:300])), (5, " ".join(base[20:300]))]
    got = {(r.doc_a, r.doc_b) for r in nd.linked_pairs(nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", threshold=0.6, width=3)).collect()}
    assert got == {(1, 2), (4, 5)} == brute(rows, 3, 3, 0.6)


def test_groups_join_copies_and_chains(spark):
    a = " ".join(WORDS * 3)
    rows = [(1, a), (2, a), (3, a + " more"), (4, a + " more words"), (9, "quite another text than the others here it is")]
    out = {r.id: (r.class_id, r.group_id, r.n_links) for r in nd.groups(nd.near_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", "text", threshold=0.8, width=3)).collect()}
    assert out[1] == out[2] and out[1][0] == 1
    assert {out[i][1] for i in (1, 2, 3, 4)} == {1} and out[9] == (9, 9, 0)


def test_empty_table(spark):
    found = nd.near_duplicates(spark.createDataFrame([], "id long, text string"), "id", "text")
    assert nd.linked_pairs(found).count() == 0 and nd.groups(found).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**40 - 1), unique=True, max_size=400))
def test_pack_round_trip(grams):
    grams = np.sort(np.array(grams, np.uint64))
    assert (nd.unpack(nd.pack(grams)) == grams).all()


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 2**40 - 1), min_size=1, max_size=700), st.sets(st.integers(0, 2**40 - 1), min_size=1, max_size=700))
def test_sketches_never_bound_an_overlap_too_low(x, y):
    y = set(list(x)[: len(x) // 2]) | y
    sets = [np.sort(np.array(list(s), np.uint64)) for s in (x, y)]
    size = np.array([len(s) for s in sets])
    flat, words = nd.sketches(np.concatenate(sets), size)
    a, b = flat[: words[0]], flat[words[0] :]
    n = min(words)
    a, b = (np.bitwise_xor.reduce(s.reshape(-1, n), axis=0) for s in (a, b))
    assert int(np.bitwise_count(a ^ b).sum()) <= len(x ^ y)
