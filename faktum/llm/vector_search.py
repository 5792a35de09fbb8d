"""Exact top-k inner products by a three-phase uniform threshold.

Vectors are cut into lists by groups of dimensions; a list holds each vector's
partial score.  Rows lie in blocks, and blocks in GROUPS groups; the blocks of
queries, which are few, are sent to every group and meet each block of rows
there, a matrix product each.

1. Each meeting computes the first list alone, takes its k best vectors and
   scores these fully: local score lists.  The k-th best score of a query over
   all meetings is a lower bound of its true k-th best: the safe cutoff tau,
   which goes to the queries' blocks.
2. A vector that scores tau or more has at least tau / m in one of its m lists.
   In each list it has at most the product of the two norms there.  Vectors
   whose norms reach tau / m in no list, or whose bounds add up to less than
   tau, are never multiplied; the others' lists are computed one after the
   other, and a vector goes as soon as what is known and the bounds of the rest
   add up to less than tau.
3. What is left then is scored fully, and the k best of each meeting go to the
   query's final ranking.

Components become floor(scale * x) with x as double, so scores are integers
and exact: in doubles below 2**53, else in 64-bit integers; a score that could
pass 2**63 raises an OverflowError.  Vectors that are null, empty, hold null or
non-finite components, have a null id or another length than the commonest take
no part.  Ties go to the smaller id.  Rows that repeat an id are candidates
each (of equal rows k are enough); a query never meets rows of its own id, and
of different vectors of one query id the least asks.  Empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.llm import textkit
from faktum.llm.storage import cut, table

LISTS = 4
ROWS_A_BLOCK, QUERIES_A_BLOCK = 4096, 1024
#: Groups of row blocks, at most; each is sent the queries once.
GROUPS = 4096

BLOCK_DDL = "block long, ids binary, vectors binary"


def _quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return rows.limit(0)
    return rows.filter(F.size("v") == length["n"]).withColumn("v", F.transform("v", lambda x: F.floor(x * float(scale)).cast("double")))


def _packed(rows: DataFrame, n: int, size: int) -> DataFrame:
    """Blocks of about `size` of the n rows (vec_id, v, copy): ids and vectors as bytes."""
    blocks = max(1, -(-n // size))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", "copy"), F.lit(blocks)))

    def pack(group: pa.Table) -> pa.Table:
        ids = group["vec_id"].to_numpy().astype("<i8")
        flat = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        return pa.table({"block": group["block"][:1], "ids": pa.array([ids.tobytes()]), "vectors": pa.array([flat.astype("<f8").tobytes()])})

    return rows.groupBy("block").applyInArrow(pack, BLOCK_DDL)


def _arrays(batch, i: int, prefix: str) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(batch.column(f"{prefix}_ids")[i].as_py(), "<i8")
    return ids, np.frombuffer(batch.column(f"{prefix}_vectors")[i].as_py(), "<f8").reshape(len(ids), -1)


def _lists(q: np.ndarray, v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The lists' parts of both sides, in a type that keeps every score exact."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if most >= 2.0**63:
        raise OverflowError("scores can pass 2**63")
    kind = np.float64 if most < 2.0**53 else np.int64
    q, v = q.astype(kind), v.astype(kind)
    cuts = np.linspace(0, q.shape[1], min(LISTS, q.shape[1]) + 1).astype(int)
    return [(q[:, a:b], v[:, a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _norms(x: np.ndarray) -> np.ndarray:
    """A little more than the norms of the rows, so that rounding loses nothing."""
    x = x.astype(np.float64)
    return np.sqrt(np.einsum("ij,ij->i", x, x)) * (1 + 1e-12)


def _full(lists, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return sum(np.einsum("ij,ij->i", q[rows], v[columns]) for q, v in lists)


def survivors(lists, tau: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(rows, columns, scores) of the allowed pairs that score their row's tau or more, and how many list products were computed for that."""
    m = len(lists)
    bounds = [_norms(q)[:, None] * _norms(v)[None, :] for q, v in lists]
    rest = sum(bounds)
    slack = np.abs(tau) * 1e-12 + 1e-6
    some = allowed & (rest >= tau - slack) & np.logical_or.reduce([x >= tau / m - slack for x in bounds])
    rows, columns = np.nonzero(some)
    known = np.zeros(len(rows), lists[0][0].dtype)
    computed = 0
    for (q, v), bound in zip(lists, bounds, strict=True):
        rest = rest - bound
        if 4 * len(rows) > some.size:
            known = known + (q @ v.T)[rows, columns]
            computed += some.size
        else:
            known = known + np.einsum("ij,ij->i", q[rows], v[columns])
            computed += len(rows)
        keep = known + np.maximum(rest[rows, columns], 0) * (1 + 1e-12) >= tau[rows, 0] - slack[rows, 0]
        rows, columns, known = rows[keep], columns[keep], known[keep]
    hit = known >= tau[rows, 0]
    return rows[hit], columns[hit], known[hit], computed


def _best(query: np.ndarray, ids: np.ndarray, value: np.ndarray, rows: np.ndarray, columns: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of each query among (row, column) pairs with their scores."""
    order = np.lexsort((ids[columns], -value, rows))
    rows, columns, value = rows[order], columns[order], value[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return query[rows[keep]], ids[columns[keep]], value[keep].astype(np.int64)


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
FOUND_DDL = "query_id long, vec_id long, score long"


def _local_lists(k: int):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (query, q), (ids, v) = _arrays(batch, i, "q"), _arrays(batch, i, "r")
                lists = _lists(q, v)
                own = query[:, None] == ids[None, :]
                top = min(k, len(ids))
                part = np.where(own, -np.inf, lists[0][0] @ lists[0][1].T)
                columns = np.argpartition(part, len(ids) - top, axis=1)[:, len(ids) - top :].ravel()
                rows = np.repeat(np.arange(len(query)), top)
                other = ~own[rows, columns]
                rows, columns = rows[other], columns[other]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(query, ids, _full(lists, rows, columns), rows, columns, k)], schema=FOUND)

    return run


def _sufficient(k: int):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                (query, q), (ids, v) = _arrays(batch, i, "q"), _arrays(batch, i, "r")
                tau = dict(zip(batch.column("cut_ids")[i].as_py() or [], batch.column("cut_scores")[i].as_py() or [], strict=True))
                lists = _lists(q, v)
                least = -float(2**63)  # of a query that has no k-th best yet
                tau = np.array([tau.get(x, least) for x in query.tolist()], np.float64)[:, None]
                rows, columns, scores, _ = survivors(lists, tau, query[:, None] != ids[None, :])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _best(query, ids, scores, rows, columns, k)], schema=FOUND)

    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose vec_id is divisible by `every`."""
    rows = cut(_quantised(vectors, scale).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")))
    asks = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("copy", F.lit(1))
    rows = rows.select("vec_id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    sizes = rows.agg(F.count(F.lit(1)), F.countDistinct(F.when(F.col("vec_id") % every == 0, F.col("vec_id")))).first()
    groups = min(GROUPS, max(1, -(-sizes[0] // ROWS_A_BLOCK)))
    blocks = _packed(rows, sizes[0], ROWS_A_BLOCK).select((F.col("block") % groups).alias("meet"), F.col("ids").alias("r_ids"), F.col("vectors").alias("r_vectors"))
    queries = _packed(asks, sizes[1], QUERIES_A_BLOCK).select(F.col("block").alias("q_block"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    blocks, queries = cut(blocks), cut(queries)

    def meetings(asked: DataFrame) -> DataFrame:
        return blocks.join(asked.withColumn("meet", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))), "meet")

    local = meetings(queries).mapInArrow(textkit.tidy(_local_lists(k)), FOUND_DDL)
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    tau = local.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") == k).select("query_id", "score")
    owner = queries.select("q_block", "q_ids").mapInArrow(textkit.tidy(_ids), "q_block long, query_id long")
    tau = owner.join(tau, "query_id").groupBy("q_block").agg(F.collect_list("query_id").alias("cut_ids"), F.collect_list("score").alias("cut_scores"))
    found = meetings(queries.join(cut(tau), "q_block", "left")).mapInArrow(textkit.tidy(_sufficient(k)), FOUND_DDL)
    ranked = found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _ids(batches):
    for batch in batches:
        for i in range(len(batch)):
            ids = np.frombuffer(batch.column("q_ids")[i].as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), batch.column("q_block")[i].as_py())), pa.array(ids)], names=["q_block", "query_id"])


def op5_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH r AS (SELECT vec_id, list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM r q JOIN r c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 5
"""
