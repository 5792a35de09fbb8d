import hashlib

import duckdb
import numpy as np
import pytest

from faktum.llm import vector_codes
from faktum.llm.vector_codes import OP13_SQL, compress, digest, op13_vector_codes, parts_of

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, parts, entries, rounds, scale):
    """Row by row in Python's integers."""
    rows = [(i, [int(np.floor(scale * x)) for x in v], label) for i, v, label in rows]
    n = len(rows[0][1])
    cuts = parts_of(n, parts)
    least = {}
    for i, v, _ in rows:
        if i is not None:
            least[i] = min(least.get(i, v), v)
    books = [[least[i][a:b] for i in sorted(least)[:entries]] for a, b in cuts]

    def nearest(x, book):
        return min((sum((p - q) ** 2 for p, q in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for k, (a, b) in enumerate(cuts):
            own = [(nearest(v[a:b], books[k])[1], v[a:b]) for _, v, _ in rows]
            for e in range(len(books[k])):
                mine = [x for c, x in own if c == e]
                if mine:
                    books[k][e] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    out, totals = [], {}
    for i, v, label in rows:
        best = [nearest(v[a:b], books[k]) for k, (a, b) in enumerate(cuts)]
        error = sum(d for d, _ in best)
        totals[label] = totals.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in best), error, label))
    return [(i, code, error, totals[label]) for i, code, error, label in out], books


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert sorted(map(tuple, op13_vector_codes(spark, SF).collect())) == sorted(con.sql(OP13_SQL).fetchall())


@pytest.mark.parametrize(("labels", "dims", "repeats"), [(50_000, 8, 1), (1, 8, 40), (1, 10, 2)])
def test_equals_brute_force(spark, monkeypatch, labels, dims, repeats):
    """Small blocks, ties, repeated rows and ids, null ids and labels, lengths that don't divide, and totals joined both ways."""
    monkeypatch.setattr(vector_codes, "LABELS", labels)
    monkeypatch.setattr(vector_codes, "ROWS_A_BLOCK", 7)
    rng = np.random.default_rng(5)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, dims)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(90)]
    rows += [(5, [9.0] * dims, 1)] * repeats + [(None, [-50.0] * dims, None), (1000, [0.1] * dims, 2)]
    odd = [(-1, None, 1), (-2, [], 1), (-3, [1.0, None] + [0.0] * (dims - 2), 1), (-4, [float("nan")] * dims, 1), (-5, [float("-inf")] * dims, 1), (-6, [1.0] * (dims + 1), 1)]
    df = spark.createDataFrame(rows + odd, SCHEMA).withColumn("ids", vector_codes.F.lit(1)).withColumn("code", vector_codes.F.lit(1)).repartition(5)
    coded, books = compress(df, 4, 6, 3, 10)
    want, wanted = brute_force(rows, 4, 6, 3, 10)
    assert [b.tolist() for b in books] == wanted
    assert sorted(((r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()), key=str) == sorted(want, key=str)
    assert digest(books) == hashlib.sha256(",".join(str(x) for b in wanted for e in b for x in e).encode()).hexdigest()


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(3, [0.5, -0.5, 1.0], 1)], SCHEMA)
    coded, books = compress(df, 2, 4, 2, 2)
    assert [tuple(r) for r in coded.collect()] == [(3, "1", "0000", 0, 0)] and [b.tolist() for b in books] == [[[1, -1]], [[2]]]
    assert compress(df.limit(0))[0].collect() == []
    assert compress(df.limit(0))[0].columns == coded.columns


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="pass 2"):
        compress(spark.createDataFrame([(3, [1e12] * 8, 1)], SCHEMA))
