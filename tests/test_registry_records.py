import json

from faktum.operators.registry_records import FLAGS, NUMBERS, TEXTS, facts


def test_every_field(spark):
    record = {x: x for x in TEXTS} | {x: k for k, x in enumerate(NUMBERS)} | {x: k % 2 == 0 for k, x in enumerate(FLAGS)} | {"published_at": 86_400 * 9 + 5, "previous_published_at": 86_400 * 2, "rating": 4.3}
    got = {r.key: r.text if r.number is None else r.number for r in facts(spark.createDataFrame([(1, json.dumps(record))], "id int, doc string"), ["id"], "doc").collect()}
    want = {f"registry.{x}": x for x in TEXTS} | {f"registry.{x}": float(record[x]) for x in NUMBERS} | {f"registry.{x}": float(record[x]) for x in FLAGS} | {"registry.is_deprecated": 1.0, "registry.days_since_previous_release": 7.0}
    assert abs(got.pop("registry.rating") - 4.3) < 1e-6 and want.pop("registry.rating")
    assert got == want and len(want) == 36


def test_what_is_left_out(spark):
    least = {"ecosystem": "npm", "name": "x", "version": "1"}
    rows = [(1, json.dumps(least | {"author": "", "published_at": 5, "previous_published_at": 9})), (2, json.dumps({"name": "x"})), (3, "{bad"), (4, None), (5, "[]"), (6, json.dumps(least | {"deprecated": ""}))]
    got = sorted((r.id, r.key.removeprefix("registry."), r.text, r.number) for r in facts(spark.createDataFrame(rows, "id int, doc string"), ["id"], "doc").collect() if r.key not in ("registry.ecosystem", "registry.name", "registry.version"))
    assert got == [(1, "days_since_previous_release", None, 0.0), (1, "is_deprecated", None, 0.0), (1, "previous_published_at", None, 9.0), (1, "published_at", None, 5.0), (6, "is_deprecated", None, 1.0)]
