from pyspark.sql import functions as F

from faktum.functions.locate import locate, offsets


def test_forward_then_anywhere_then_anchor():
    text = b"use a/x@1\nuse b/y@2\nuse a/x@1\nfetch http://h/z \\\n  now\n"
    found = offsets(text, [b"use a/x@1", b"use b/y@2", b"use a/x@1", b"use b/y@2", b"http://h/z now", b"none"], [b"", b"", b"", b"", b"http://h/z", b"nowhere"])
    assert found == [0, 10, 20, 10, 36, 0]
    assert offsets(b"aa", [b"a", b"a"], [b"", b""]) == [0, 0]  # one place may be two items'


def test_budget():
    text = b"x" * 10 + b"last"
    assert offsets(text, [b"last", b"x", b"x", b"xx"], [b""] * 4, budget=1) == [10, 0, 0, 0]
    assert offsets(text, [b"last", b"xlast", b"last"], [b""] * 3, budget=100) == [10, 9, 10]


def test_columns(spark):
    df = spark.createDataFrame([("é a b", ["a", "b"]), (None, ["a"]), ("x", None), ("", [])], "t string, e array<string>")
    assert [r.o for r in df.select(locate(F.col("t"), F.col("e"), F.col("e")).alias("o")).collect()] == [[3, 5], None, None, []]
