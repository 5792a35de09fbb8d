import duckdb
import numpy as np

from faktum.llm import vector_search
from faktum.llm.vector_search import OP5_SQL, op5_top_k, top_k

SF = "/root/testdata/sf0.001"


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, op5_top_k(spark, SF).collect())) == sorted(con.sql(OP5_SQL).fetchall())


def test_small_blocks_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "ROWS_A_BLOCK", 16)
    monkeypatch.setattr(vector_search, "QUERIES_A_BLOCK", 3)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 6)]) for i in range(120)]
    rows += [(200, None), (250, []), (300, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (350, [float("nan")] * 6), (400, [float("inf")] * 6), (None, [1.0] * 6), (7, [2.0] * 6), (450, [1.0] * 5)]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 5, 10, 4).collect()
    whole = [(i, np.floor(4 * np.array(v))) for i, v in rows if i is not None and v and len(v) == 6 and None not in v and np.isfinite(v).all()]
    want = set()
    for q, qv in whole:
        if q % 10 == 0:
            ranked = sorted((-int(qv @ v), i) for i, v in whole if i != q)[:5]
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(ranked)}
    assert {tuple(r) for r in got} == want


def test_survivors_are_those_at_the_cutoff():
    rng = np.random.default_rng(8)
    q, v = rng.integers(-300, 300, (7, 24)).astype(float), np.vstack([rng.integers(-300, 300, (40, 24)), rng.integers(-20, 20, (400, 24))]).astype(float)
    scores = q @ v.T
    tau = np.sort(scores, axis=1)[:, -5:-4]
    rows, columns, found, computed = vector_search.survivors(vector_search._lists(q, v), tau, np.ones(scores.shape, bool))
    assert set(zip(rows.tolist(), columns.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(scores >= tau)), strict=True))
    assert (found == scores[rows, columns]).all()
    assert computed < 0.25 * vector_search.LISTS * scores.size  # most products are never made


def test_large_components_and_repeats(spark):
    rows = [(50, [2.0**22, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 1.0]), (3, [1.0, 1.0]), (3, [1.0, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    got = top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", vector_search.F.lit(1)).withColumn("block", vector_search.F.lit(1))).collect()
    whole = sorted(((-sum(int(256 * a) * int(256 * b) for a, b in zip(rows[0][1], v, strict=True)), i) for i, v in rows[1:]))[:5]
    assert sorted((r.rank, r.vec_id, r.score) for r in got) == [(k + 1, i, -s) for k, (s, i) in enumerate(whole)]


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in top_k(df).collect()] == [(0, 1, 1, 256 * 512)]
    assert top_k(df.limit(0)).collect() == []
    assert top_k(df.filter("vec_id = 0")).collect() == []
