import collections
import random

import numpy as np
import pytest

from faktum.llm import near_dedup
from faktum.llm.near_dedup import drop, groups, op1_near_dedup

SF = "/root/testdata/sf0.001"


def brute_force(rows, width=4, percent=80):
    """{doc_id: (n_shingles, component)} by comparing all sets that share a shingle."""
    sets = []
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    having = collections.defaultdict(list)
    for at, (i, own) in enumerate(sets):
        shared = collections.Counter(b for s in own for b in having[s])
        for b, both in shared.items():
            j, other = sets[b]
            if 100 * both >= percent * (len(own) + len(other) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
        for s in own:
            having[s].append(at)
    return {(i, len(own), find(i)) for i, own in sets}


def check(spark, rows, **kw):
    got = groups(spark.createDataFrame(rows, "doc_id long, text string"), **kw).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == brute_force(rows, **kw)
    assert len(got) == len(rows) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in op1_near_dedup(spark, SF).collect()}
    assert got == brute_force([(d.doc_id, d.text) for d in docs])


def test_chains_and_large_groups(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(150):  # each is near the base, few are near each other
        own = list(base)
        for _ in range(rng.choice([1, 3, 5])):
            own[rng.randrange(200)] = f"v{rng.randrange(10**6)}"
        rows.append((1000 - i, " ".join(own)))
    chain = [f"c{k}" for k in range(300)]
    rows += [(2000 + i, " ".join(chain[i * 8 : i * 8 + 150])) for i in range(15)]
    rows += [(3000 + i, " ".join(base[:60] + [f"x{i}-{k}" for k in range(60)])) for i in range(40)]
    check(spark, rows)
    check(spark, rows, width=5)


def test_small_blocks(spark, monkeypatch):
    """Buckets and clusters dealt out in blocks lose no link."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 8)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 600)
    test_chains_and_large_groups(spark)


def look_alikes(n, seed=11):
    """Documents of 60 words, each with 2 of them changed: alike enough for one cluster, few of them linked."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        own = list(base)
        for k in rng.sample(range(60), 2):
            own[k] = f"v{rng.randrange(10**9)}"
        rows.append((i, " ".join(own)))
    return rows


def test_clusters_of_look_alikes(spark, monkeypatch):
    """Parted by prefix filtering, in small blocks: no link is lost, and few full sets meet again."""
    monkeypatch.setattr(near_dedup, "BUCKET_BLOCK", 64)
    monkeypatch.setattr(near_dedup, "CLUSTER_BLOCK", 4000)
    seen = []
    real = near_dedup._linkable
    monkeypatch.setattr(near_dedup, "_linkable", lambda *a: seen.append(a[1].count()) or real(*a))
    check(spark, look_alikes(700))
    assert seen and seen[0] > 350


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_prefixes_lose_no_link(percent):
    rng = np.random.default_rng(12)
    counts = np.zeros(near_dedup.COUNTERS, np.int64)
    for _ in range(400):
        universe = rng.choice(10**6, 60, replace=False).astype(np.uint64)
        x, y = (np.sort(rng.choice(universe, rng.integers(1, 60), replace=False)) for _ in range(2))
        x = np.unique(np.concatenate([x, y[: rng.integers(0, len(y) + 1)]]))
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both):
            continue
        (small, large) = sorted((x, y), key=len)
        order = lambda s: s[np.lexsort((s, counts[(s % np.uint64(near_dedup.COUNTERS)).astype(np.int64)]))]
        a, b = order(small)[: near_dedup.prefix_lengths(len(small), percent)[0]].tolist(), order(large)[: near_dedup.prefix_lengths(len(large), percent)[1]].tolist()
        shared = [(i, b.index(t)) for i, t in enumerate(a) if t in b]
        assert shared
        i, j = shared[0]
        assert (100 + percent) * min(len(small) - i, len(large) - j) >= percent * (len(small) + len(large))


def test_recall_at_the_threshold(spark):
    """Pairs just above the threshold, on all documents of sf0.1: those at 0.80 to 0.82 are all connected."""
    docs = [(d.doc_id, d.text) for d in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").collect()]
    got = {r.doc_id: r.component_id for r in groups(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).collect()}
    sets, having, near = {}, collections.defaultdict(list), []
    for i, text in docs:
        w = (text or "").encode().lower().split()
        own = frozenset(hash(tuple(w[k : k + 4])) for k in range(max(1, len(w) - 3))) if w else frozenset()
        shared = collections.Counter(j for s in own for j in having[s])
        near += [(i, j, both / (len(own) + len(sets[j]) - both)) for j, both in shared.items() if 100 * both >= 80 * (len(own) + len(sets[j]) - both)]
        sets[i] = own
        for s in own:
            having[s].append(i)
    assert sum(x <= 0.82 for _, _, x in near) >= 10
    assert all(got[i] == got[j] for i, j, _ in near)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "  "), (4, "one"), (5, "One"), (6, "one two"), (7, "a b c d"), (8, "A\tB c  d"), (9, "long " * 200_000), (10, "a b c d"), (10, "a b c d"), (11, "x"), (12, "é É")]
    check(spark, rows)
    got = groups(spark.createDataFrame([*rows, (None, "a b c d")], "doc_id long, text string")).filter("doc_id is null").collect()
    assert [(r.n_shingles, r.component_id, r.kept) for r in got] == [(1, None, True)]
    assert groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    # an id with two texts binds what each is linked with
    two = [(1, "a b c d e"), (5, "a b c d e"), (5, "v w x y z"), (9, "V w x y z")]
    assert {(r.doc_id, r.component_id) for r in groups(spark.createDataFrame(two, "doc_id long, text string")).collect()} == {(1, 1), (5, 1), (9, 1)}


def test_drop_keeps_columns(spark):
    rows = [(1, "a b c d e f", 1), (2, "a b c d e f", 2), (3, "z", 3), (None, "z", 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep int")
    assert sorted(map(tuple, drop(df).collect()), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)


@pytest.mark.parametrize("same", [0.0, 0.5, 0.8, 1.0])
def test_estimate(same):
    rng = np.random.default_rng(3)
    n = 2000
    values = rng.integers(0, 1 << 63, 2 * n, dtype=np.uint64)
    both = int(n * 2 * same / (1 + same))
    work = np.empty((near_dedup._STEP, near_dedup.HASHES), np.uint32)
    packed = near_dedup.pack(np.array([near_dedup.minima(values[:n], work), near_dedup.minima(values[n - both : 2 * n - both], work)]))
    assert near_dedup.similarity(packed[0].view(np.uint64), packed[1:].view(np.uint64))[0] == pytest.approx(same, abs=0.15)
