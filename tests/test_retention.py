"""Retention against a sorted loop, with bursts in one minute, hour and day."""

import numpy as np
import pytest

from faktum.operators.records import retained


def by_loop(rows, now, ttl, items, size, share):
    live = sorted((r for r in rows if r[1] >= now - ttl), key=lambda r: (-r[1], r[0]))
    if len(live) <= items and sum(r[2] for r in live) <= size:
        return set(live)
    out, total = set(), 0
    for rank, r in enumerate(live, 1):
        total += r[2]
        if rank <= items * share and total <= size * share:
            out.add(r)
    return out


@pytest.mark.parametrize(("items", "size"), [(10_000, 10**9), (150, 10**9), (10_000, 2_000), (150, 3_000)])
def test_equals_a_loop(spark, items, size):
    rng = np.random.default_rng(1)
    now = 10_000_000
    ages = np.concatenate([rng.integers(0, 3_000_000, 200), rng.integers(86_400, 86_460, 100), rng.integers(500_000, 503_600, 60)])
    rows = [(f"k{i}", int(now - a), int(b)) for i, (a, b) in enumerate(zip(ages, rng.integers(0, 40, len(ages)), strict=True))]
    got = {tuple(r) for r in retained(spark.createDataFrame(rows, "key string, used_at long, bytes long").repartition(4), now, 2_592_000, items, size, 0.9).collect()}
    assert got == by_loop(rows, now, 2_592_000, items, size, 0.9)
    assert retained(spark.createDataFrame(rows[:0], "key string, used_at long, bytes long"), now).count() == 0
