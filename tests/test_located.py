"""Places: prefix sums, runs and windows over chunks, held against plain loops, for small groups and stretches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faktum.functions import text as T
from faktum.functions.bytes import windowed
from faktum.operators import located


@pytest.fixture
def small(monkeypatch):
    monkeypatch.setattr(located, "FAN", 3)
    monkeypatch.setattr(located, "STRETCH", 2048)


def by_push(spans, cap):
    """The rule itself: a span that begins where the last one ends extends it, empty ones are nothing, and after `cap` runs new ones go."""
    out = []
    for offset, size in sorted(spans):
        if not size:
            continue
        if out and sum(out[-1]) == offset:
            out[-1][1] += size
        else:
            out.append([offset, size])
    return [tuple(x) for x in out[:cap]], len(out)


@pytest.mark.parametrize("stretch", [4, 64, 1 << 24])
def test_runs(spark, stretch):
    rng = np.random.default_rng(1)
    rows = [(k, int(o), int(n)) for k, most in (("a", 300), ("b", 5000), (None, 50)) for o, n in zip(rng.integers(0, most, 150) * 2, rng.integers(0, 3, 150) * 2, strict=True)]
    rows += [("c", i, 1) for i in range(200)] + [("d", 7, 0)]
    rows = list({(k, o): (k, o, n) for k, o, n in rows}.values())
    found = located.runs(spark.createDataFrame(rows, "k string, offset long, len long").repartition(5), ["k"], stretch=stretch)
    got = {r.k: ([tuple(x) for x in r.spans], r.n_runs, r.covered) for r in located.listed(found, ["k"], 9).collect()}
    for k in {r[0] for r in rows if r[2]}:
        own = [(o, n) for x, o, n in rows if x == k]
        assert got[k] == (*by_push(own, 9), sum(n for _, n in own))
    assert "d" not in got and got["c"] == ([(0, 200)], 1, 200)
    longest = {r.k: [x.len for x in r.spans] for r in located.listed(found, ["k"], 3, by_size=True).collect()}
    assert all(x == sorted((n for _, n in by_push([(o, n) for y, o, n in rows if y == k], 10**6)[0]), reverse=True)[:3] for k, x in longest.items())


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_offsets(spark, small, levels):
    rng = np.random.default_rng(2)
    rows = [(k, int(i), None if i % 11 == 0 else int(n)) for k in ("a", None) for i, n in zip(rng.permutation(120) - 40, rng.integers(0, 9, 120), strict=True)]
    got = located.offsets(spark.createDataFrame(rows, "k string, i long, n long").repartition(4), ["k"], "i", F.col("n"), levels).collect()
    assert len(got) == len(rows) and got[0].__fields__ == ["k", "i", "n", "offset"]
    for r in got:
        assert r.offset == sum(n or 0 for k, i, n in rows if k == r.k and i < r.i)


@pytest.mark.parametrize("size", [1, 100, 1023, 1024, 5000, 10**6])
def test_windows_are_the_same_for_any_chunks(spark, small, size):
    rng = np.random.default_rng(3)
    contents = {"low": bytes(9000), "mixed": bytes(3000) + bytes(rng.integers(0, 256, 4096).tolist()) + bytes(5000) + bytes(rng.integers(0, 256, 1500).tolist()), "short": b"abc", "empty": b""}
    if size == 1:
        contents = {k: v[:1400] for k, v in contents.items()}
    rows = [(k, i, v[lo : lo + size]) for k, v in contents.items() for i, lo in enumerate(range(0, max(len(v), 1), size))] + [("low", 10**6, None)]
    got = {r.k: r for r in located.peak_regions(spark.createDataFrame(rows, "k string, i long, content binary").repartition(3), ["k"], "i", "content").collect()}
    assert set(got) == {"low", "mixed", "short"}
    for k, r in got.items():
        overall, peak, covered, _, spans = windowed(contents[k])
        assert (r.overall, r.peak) == (pytest.approx(overall, abs=1e-8), pytest.approx(peak, abs=1e-8))
        assert (r.size, r.covered, r.n_runs, [tuple(x) for x in r.spans]) == (len(contents[k]), covered, len(spans), spans)


def test_strings_over_chunks(spark, small):
    rows = [("a", 0, b"\0\0hello\0abc\xff"), ("a", 1, b"world"), ("a", 2, b"\tfour\0longest string\0"), ("a", 3, b"longest strinG"), ("b", 0, b"\0"), ("c", 5, None)]
    got = located.string_facts(spark.createDataFrame(rows, "k string, i long, content binary"), ["k"], "i", "content", 2.0).collect()
    # "world" and the tab with "four" are neighbours, so one run
    assert [(r.k, r.string_count, r.max_string_length, r.max_offset, r.high_entropy_count, r.n_runs) for r in got] == [("a", 5, 14, 23, 4, 3)]
    assert [tuple(x) for x in got[0].spans] == [(12, 10), (23, 14), (38, 14)]


@pytest.mark.parametrize("most", [0, 100])
def test_totals_are_joined_both_ways(spark, monkeypatch, most):
    monkeypatch.setattr(located, "BROADCAST", most)
    rows = spark.createDataFrame([(i % 3 or None, i) for i in range(90)], "k int, v int")
    totals = rows.groupBy("k").agg(F.sum("v").alias("t"))
    got = located.join_totals(rows, totals, ["k"]).collect()
    want = {k: sum(v for v in range(90) if (v % 3 or None) == k) for k in (None, 1, 2)}
    assert sorted((r.v, r.t) for r in got) == [(i, want[i % 3 or None]) for i in range(90)] and got[0].__fields__ == ["k", "v", "t"]


def test_spans_of_texts(spark):
    hidden = "​"
    texts = ["ab​c​d", "a​⁠﻿b", "﻿x﻿", "", None, "né​", "x" + "a​" * 100, "​", "plain", "a\r\nbcd\r\n\xe9\xe9x\nzz", "\n\n", "same\nsize"]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", T.invisible_spans(F.col("t")).alias("s"), T.longest_line_spans(F.col("t")).alias("l")).orderBy("i").collect()
    spans = [[tuple(x) for x in r.s] if r.s is not None else None for r in got]
    assert spans[0] == [(2, 3), (6, 3)] and spans[1] == [(1, 9)] and spans[2] == [(4, 3)] and spans[3] == [] and spans[5] == [(3, 3)] and spans[7] == [(0, 3)] and spans[8] == []
    assert len(spans[6]) == 64 and spans[6][63] == (2 + 63 * 4, 3) and hidden
    lines = [[tuple(x) for x in r.l] if r.l is not None else None for r in got]
    assert lines[9] == [(8, 5)] and lines[10] == [] and lines[11] == [(0, 4)] and lines[8] == [(0, 5)]


def test_runs_and_art_within_lines(spark):
    """White space at both ends of a line counts for nothing; art is over seven tenths of what is between."""
    from pyspark.sql import functions as F

    from faktum.functions.text import text_metrics

    texts = ["  a b\t", "   a", "a  \t b   ", "  a b", "  " + "=" * 20 + "  ", "=" * 14 + "x" * 6, "=" * 15 + "x" * 5, "=" * 19]
    own = text_metrics(F.col("t"))
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, t string").orderBy("k")
    got = df.select(own["max_inline_whitespace_run"].alias("run"), own["ascii_art_lines"].alias("art")).collect()
    assert [r.run for r in got] == [1, None, 4, 1, None, None, None, None] and [r.art for r in got] == [None, None, None, None, 1, None, 1, None]
