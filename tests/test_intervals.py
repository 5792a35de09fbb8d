"""Interval joins and counts against all pairs."""

import numpy as np
import pytest

from faktum.operators import intervals
from faktum.operators.intervals import overlap_counts, overlaps


def made(rng, n, lengths, prefix):
    return [(str(rng.integers(0, 3)), f"{prefix}{i}", int(s), int(s + rng.choice(lengths))) for i, s in enumerate(rng.integers(-500, 500, n))] + [(None, f"{prefix}null", 0, 5)]


@pytest.mark.parametrize(("one", "other"), [([1], [1, 2, 3]), ([0, 1, 4, 5, 16, 64], [1, 17, 1000]), ([1000, 3], [1000, 2, 5])])
def test_overlaps(spark, one, other):
    rng = np.random.default_rng(3)
    left, right = made(rng, 120, one, "l"), made(rng, 90, other, "r")
    left += [("hot", f"h{i}", i, i + 2) for i in range(60)]
    right += [("hot", "all", -9, 99), ("hot", "none", 200, 201)]
    frames = spark.createDataFrame(left, "k string, x string, a long, b long"), spark.createDataFrame(right, "k string, y string, c long, d long")
    got = [(r.k, r.x, r.y) for r in overlaps(*frames, ["k"], ("a", "b"), ("c", "d")).collect()]
    want = {(k, x, y) for k, x, a, b in left for o, y, c, d in right if k is not None and k == o and max(a, c) < min(b, d)}
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("stretches", [1, 7, 1024])
def test_counts(spark, monkeypatch, stretches):
    monkeypatch.setattr(intervals, "STRETCHES", stretches)
    rng = np.random.default_rng(4)
    asked, others = made(rng, 150, [0, 1, 9, 300], "q"), made(rng, 200, [0, 1, 9, 300, 2000], "o")
    frames = spark.createDataFrame([x for x in asked if x[0]], "k string, i string, a long, b long"), spark.createDataFrame([x for x in others if x[0]], "k string, i string, a long, b long")
    got = {r.i: r.n for r in overlap_counts(*frames, ["k"], ("a", "b"), "i").collect()}
    assert got == {i: sum(k == o and max(a, c) < min(b, d) for o, _, c, d in others) for k, i, a, b in asked if k and b > a}
    assert overlap_counts(frames[0], frames[1].limit(0), ["k"], ("a", "b"), "i").filter("n <> 0").count() == 0


def test_levels_that_the_other_side_lacks_are_not_joined(spark):
    points = spark.createDataFrame([("k", i, i, i + 1) for i in range(20)], "k string, y long, c long, d long")
    spans = spark.createDataFrame([("k", i, i, i + 9) for i in range(20)], "k string, x long, a long, b long")
    found = overlaps(spans, points, ["k"], ("a", "b"), ("c", "d"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert sorted((r.x, r.y) for r in found.collect()) == [(x, y) for x in range(20) for y in range(20) if x <= y < x + 9]
