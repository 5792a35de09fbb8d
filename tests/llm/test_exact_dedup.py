import duckdb
from pyspark.sql import functions as F

from faktum.llm.exact_dedup import OP4_SQL, drop, mark, op4_exact_dedup

SF = "/root/testdata/sf0.001"
ROWS = [(1, "a  b", "x"), (2, "a\tb", "y"), (3, "A b", "z"), (4, None, None), (5, "", "q"), (None, "a b", "n"), (None, "only", "m"), (7, "dup", "p"), (7, "dup", "p"), (8, " ", None), (9, " " * 100_000 + "long", "l")]


def frame(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, hash string")


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, op4_exact_dedup(spark, SF).collect())) == sorted(con.sql(OP4_SQL).fetchall())


def test_odd_rows(spark):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in mark(frame(spark)).collect()), key=str)
    assert got == sorted([(1, 1, 3, True), (2, 1, 3, False), (3, 3, 1, True), (4, 4, 2, True), (5, 4, 2, False), (None, 1, 3, False), (None, None, 1, True), (7, 7, 2, True), (7, 7, 2, True), (8, 8, 1, True), (9, 9, 1, True)], key=str)
    assert mark(frame(spark).limit(0)).collect() == []


def test_collisions_are_told_apart(spark):
    want = sorted(map(tuple, mark(frame(spark)).collect()), key=str)
    one = lambda norm: F.when(F.length(norm) < 5, F.lit(b"x")).otherwise(F.unhex(F.md5(norm)))
    assert sorted(map(tuple, mark(frame(spark), one).collect()), key=str) == want


def test_drop_keeps_columns(spark):
    for hashed in (None, lambda norm: F.lit(b"same")):
        got = (drop(frame(spark)) if hashed is None else drop(frame(spark), hashed)).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted([ROWS[0], ROWS[2], ROWS[3], ROWS[6], ROWS[7], ROWS[9], ROWS[10]], key=str)
        assert got[0].__fields__ == ["doc_id", "text", "hash"]
