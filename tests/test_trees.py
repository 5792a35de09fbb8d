"""Documents as rows, held against Python's own reading of them."""

import json
import random

from pyspark.sql import functions as F

from faktum.operators.trees import assemble, flatten, insert, lookup, lookup_all, segments


def made(rng, depth=0):
    kind = rng.choice(["object", "array", "string", "number", "null", "bool"] if depth < 4 else ["string", "number"])
    if kind == "object":
        return {rng.choice(["a", "b", "c.d", "é", "", 'q"t', "e"]): made(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == "array":
        return [made(rng, depth + 1) for _ in range(rng.randrange(13))]
    return {"string": rng.choice(["x", "", 'a"b\\c\n', "ß☃", "12"]), "number": rng.randrange(-99, 10**9), "null": None, "bool": rng.random() < 0.5}[kind]


def rows_of(x, path=()):
    kind = "object" if isinstance(x, dict) else "array" if isinstance(x, list) else "null" if x is None else "boolean" if isinstance(x, bool) else "string" if isinstance(x, str) else "number"
    yield path, kind, None if kind in ("object", "array", "null") else x if kind == "string" else json.dumps(x)
    for k, v in x.items() if isinstance(x, dict) else enumerate(x) if isinstance(x, list) else ():
        yield from rows_of(v, (*path, k if isinstance(x, dict) else f"[{k}]"))


def put(x, path, value):
    x = x if isinstance(x, dict) else {}
    own = x
    for k in path.split(".")[:-1]:
        if not isinstance(own.get(k), dict):
            own[k] = {}
        own = own[k]
    own[path.split(".")[-1]] = value
    return x


def get(x, path):
    for s in segments(path):
        if s.startswith("["):
            x = x[int(s[1:-1])] if isinstance(x, list) and int(s[1:-1]) < len(x) else None
        else:
            x = x.get(s) if isinstance(x, dict) else None
        if x is None:
            return None
    return x


def test_round_trip_insertion_and_lookup(spark):
    rng = random.Random(8)
    docs = {i: made(rng) for i in range(60)} | {100: {"a": {"b": [1, {"e": "x"}]}}, 101: 5, 102: [], 103: {}}
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()] + [(200, None), (201, "{bad")], "id int, doc string")
    nodes = flatten(frame, ["id"], "doc").persist()
    assert sorted((r.id, tuple(r.path), r.kind, r.value) for r in nodes.collect()) == sorted((i, *x) for i, d in docs.items() for x in rows_of(d))
    assert {r.id: json.loads(r.json) for r in assemble(nodes, ["id"]).collect()} == docs
    for path in ("a", "a.b[1].e", "e", "a.b.e", "[0]"):
        want = {i: next(rows_of(x))[1:] for i, d in docs.items() if (x := get(d, path)) is not None}
        assert {r.id: (r.kind, r.value) for r in lookup(nodes, ["id"], path).collect() if r.kind != "null"} == want
    for path in ("a", "a.b.e", "z.y.x"):
        got = {r.id: json.loads(r.json) for r in assemble(insert(nodes, ["id"], path, "string", F.lit("new")), ["id"]).collect()}
        assert got == {i: put(json.loads(json.dumps(d)), path, "new") for i, d in docs.items()}


def test_segments():
    assert segments("a.b[3].c") == ["a", "b", "[3]", "c"] and segments("[0].x") == ["[0]", "x"]
    assert segments("a[.b") == ["a[", "b"] and segments("a[b]") == ["a[b]"] and segments("m[12]") == ["m", "[12]"]


def test_edits_move_no_nodes_that_are_dealt_by_document(spark):
    """Insertion, assembly and look-ups of nodes dealt out by their keys need no exchange beyond that one."""
    docs = spark.createDataFrame([(k, '{"a": [1, {"b": "x"}], "c": 2}') for k in range(5)], "id long, json string")
    nodes = flatten(docs, ["id"], "json").repartition(4, "id")
    found = lookup_all(nodes, ["id"], {"x": "a[1].b", "none": "d"})
    out = assemble(insert(insert(nodes, ["id"], "c.d", "number", F.lit(7)), ["id"], "e", "string", F.lit("y")), ["id"], 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert {json.dumps(json.loads(r.json)) for r in out.collect()} == {'{"a": [1, {"b": "x"}], "c": {"d": 7}, "e": "y"}'}
    assert {(r.x, r.none) for r in found.collect()} == {("x", None)}
