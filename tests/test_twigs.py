"""Tree patterns held against a walk over all nodes, on random trees; patterns that can't be read; trees of markup."""

import numpy as np
import pytest

from faktum.operators.twigs import compiled, match, match_all
from faktum.sources import markup

FIELDS = "k string, node int, parent int, last int, kind string, op string"


def random_tree(rng, key, size):
    parents = [-1] + [int(rng.integers(max(0, i - 6), i)) for i in range(1, size)]
    children = {i: [j for j in range(size) if parents[j] == i] for i in range(size)}
    out = []

    def walk(i, parent):
        number = len(out)
        out.append([key, number, parent, number, str(rng.choice(list("abc"))), str(rng.choice(["+", "%"])) if rng.random() < 0.5 else None])
        for j in children[i]:
            walk(j, number)
        out[number][3] = len(out) - 1

    walk(0, -1)
    return [tuple(x) for x in out]


def by_walk(rows, step):
    """The nodes that the last step finds, from the definition."""
    below = lambda n, axis: [m for m in rows if m[0] == n[0] and (m[2] == n[1] if axis == "/" else n[1] < m[1] <= n[3])]
    fits = lambda n, s: (s.kind in ("*", n[4])) and (s.op is None or s.op == n[5]) and all(any(ends(m, b) for m in below(n, axis)) for axis, b in s.branches)

    def ends(n, s):
        if not fits(n, s):
            return set()
        return {n} if not s.then else {x for m in below(n, s.then[0]) for x in ends(m, s.then[1])}

    return {x for n in rows for x in ends(n, step)}


@pytest.mark.parametrize("pattern", ["a", "*", "a/b", "a//b", "a[b]//c", "a[.//b:+]/c[.//*]", "a[b[.//c]/a]//b:%", "*//a//a"])
def test_equals_a_walk(spark, pattern):
    rng = np.random.default_rng(7)
    rows = [x for k in range(6) for x in random_tree(rng, f"t{k}", 60)]
    got = match(spark.createDataFrame(rows, FIELDS).repartition(3), ["k"], pattern).select("k", "node", "parent", "last", "kind", "op").collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == by_walk(rows, compiled(pattern))


@pytest.mark.parametrize("pattern", ["", "/", "a/", "a[", "a[b", "a]", "a b", "a[/b]", "a:", "£"])
def test_patterns_that_cannot_be_read(pattern):
    with pytest.raises(ValueError):
        compiled(pattern)


def test_a_bad_pattern_is_a_row(spark):
    rows = spark.createDataFrame([("t", 0, -1, 1, "a", None), ("t", 1, 0, 1, "b", None)], FIELDS)
    got = match_all(rows, ["k"], {"good": "a/b", "bad": "a[", "none": "c"}).collect()
    assert sorted((r.pattern, r.k, r.n, r.error is not None) for r in got) == [("bad", None, None, True), ("good", "t", 1, False)]


def test_markup():
    kinds = lambda html: [(r[4], r[1], r[2], r[5]) for r in markup.tree(html)[1:]]
    assert kinds('<ul class="m"><li>a<li id=x>b</ul><p>one<p>two<br></div></p>') == [("ul", 0, 3, "m"), ("li", 1, 2, None), ("li", 1, 3, "x"), ("p", 0, 4, None), ("p", 0, 6, None), ("br", 5, 6, None)]
    assert kinds("<script>if (a < b) '<p>'</script><!-- <p> --><a title='>'/><title><b></title>") == [("script", 0, 1, None), ("a", 0, 2, None), ("title", 0, 3, None)]
    assert kinds("<div><p><b>x<p>y</div><i>") == [("div", 0, 4, None), ("p", 1, 3, None), ("b", 2, 3, None), ("p", 1, 4, None), ("i", 0, 5, None)]
    assert markup.tree("") == [(0, -1, 0, 0, "document", None, 0)]


def test_markup_of_columns(spark):
    got = markup.nodes(spark.createDataFrame([(1, "<p>a"), (2, None)], "id int, html string"), ["id"], "html").collect()
    assert sorted((r.id, r.node, r.kind) for r in got) == [(1, 0, "document"), (1, 1, "p"), (2, 0, "document")]


def test_all_patterns_in_one_pass_equal_a_walk(spark):
    """Nothing is kept or broadcast, whatever the number of patterns; batches cut trees anywhere, keys may be null."""
    rng = np.random.default_rng(3)
    rows = [(None if k == 4 else x[0], *x[1:]) for k in range(8) for x in random_tree(rng, f"t{k}", 50)]
    patterns = {p: p for p in ("a", "*", "a/b", "a//b", "a[b]//c", "a[.//b:+]/c[.//*]", "a[b[.//c]/a]//b:%", "*//a//a", "a[b//a]//c/b")}
    want = {(p, k, len(found)) for p in patterns for k in {r[0] for r in rows} if (found := {x for x in by_walk(rows, compiled(p)) if x[0] == k})}
    for some in (patterns, {p: p for p in patterns if "*" not in p}):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
        try:
            found = match_all(spark.createDataFrame(rows, FIELDS).repartition(3), ["k"], some)
            got = {(r.pattern, r.k, r.n) for r in found.collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == {x for x in want if x[0] in some}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and "InMemory" not in plan
