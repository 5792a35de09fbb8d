import json

import pytest

from faktum.plans.views import PARTS, SYMBOLS, chosen, view_json


def test_selectors(spark):
    rows = [(1, [("call", "f"), ("bind", "x")], (3.0,)), (2, None, None)]
    bundles = spark.createDataFrame(rows, "file_id int, symbols array<struct<kind:string,name:string>>, metrics struct<a:double>")
    get = lambda *views: {r.file_id: json.loads(r.json) for r in view_json(bundles, list(views)).collect()}
    assert get("calls") == {1: [{"kind": "call", "name": "f"}], 2: []} and get("functions") == {1: [], 2: []}
    assert get("metrics", "metrics") == {1: {"a": 3.0}, 2: []} and get("sections") == {1: [], 2: []}
    assert get()[1].keys() == {"schema_version", *PARTS} and get("all")[2]["symbols"] == []
    assert len(PARTS) + len(SYMBOLS) + 1 == 17


def test_wrong_selectors():
    for views in (["nothing"], ["calls", "binds"], ["all", "text"]):
        with pytest.raises(ValueError):
            chosen(views)
    assert chosen([]) == "all" and chosen(["text"]) == "text"
