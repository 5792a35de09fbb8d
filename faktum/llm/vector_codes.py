"""Product quantisation of vectors: short codes from codebooks learnt over all vectors.

Vectors lie in blocks of columnar NumPy arrays (dimension by row), made where
the rows are read, without a shuffle, and written once.  Each round is one
treeAggregate over the RDD of blocks: a task adds its blocks to a tensor of
sums (part, entry, place within the part) and one of counts, both int64; the
distances of a block to a codebook are accumulated dimension by dimension, and
`np.add.at` adds the rows to the entries that they are nearest to.  The tensors
of tasks merge through a reduction tree of about FAN at a time, so the driver
meets a few of them, each of (parts * entries * places) numbers, whatever the
number of rows.  The codebooks go back to the tasks in the closure.

Components become floor(scale * x) with x as double and all arithmetic is on
64-bit integers, so results don't depend on the order of rows or on repeated
tasks; components so large that a distance could pass 2**63 raise an
OverflowError.  A label's total error is summed per block and then per label,
so a label that a third of all rows have is a few rows; totals are joined back
by broadcast while there are at most LABELS of them, and else by a join whose
labels are salted.

Vectors that are null, empty, hold null or non-finite components, or have
another length than the commonest (the longest of equally common ones) take no
part.  Parts are as equal as can be; where the length is no multiple of their
number, the first are one longer.  Seeds are the smallest different ids, ties
of one id by the least vector; a null id seeds nothing, but its row gets a
code.  With fewer ids than entries the codebooks are smaller.  Repeated rows
count each and are returned each.  Null labels are one group.  Other columns
are not read, whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm import textkit
from faktum.llm.storage import cut, table

ROWS_A_BLOCK = 4096
#: Tensors that one task of the reduction tree merges, about.
FAN = 32
#: Totals of labels up to which they are broadcast, and the salts of a label beyond.
LABELS, SALTS = 50_000, 16


def _taking_part(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(id, label, v array<double>) of the vectors that take part, and their length."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("v").isNotNull() & (F.size("v") > 0)).filter(~bad)
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    n = length["n"] if length else 0
    return rows.filter(F.size("v") == n), n


def _blocks(rows: DataFrame, n: int, scale: int) -> DataFrame:
    """ids, labels and the components, column after column, of up to ROWS_A_BLOCK rows each."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), ROWS_A_BLOCK):
                part = batch.slice(lo, ROWS_A_BLOCK)
                x = np.floor(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, n) * float(scale))
                most = float(np.abs(x).max())
                if n * (2 * most) ** 2 >= 2.0**63:
                    raise OverflowError("distances can pass 2**63")
                columns = np.ascontiguousarray(x.T, "<i4" if most < 2.0**31 else "<i8")
                made = [pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([part.column("label").to_pylist()], pa.list_(pa.string())), pa.array([columns.tobytes()]), pa.array([columns.dtype.itemsize], pa.int32())]
                yield pa.RecordBatch.from_arrays(made, names=["ids", "labels", "columns", "width"])

    return rows.mapInArrow(textkit.tidy(run), "ids array<long>, labels array<string>, columns binary, width int")


def _columns(raw: bytes, width: int, n: int) -> np.ndarray:
    """(dimension, row) in 64-bit integers."""
    return np.frombuffer(raw, f"<i{width}").reshape(n, -1).astype(np.int64)


def parts_of(n: int, parts: int) -> list[tuple[int, int]]:
    """First dimension and the one after the last of each part."""
    ends = [n // parts * k + min(k, n % parts) for k in range(parts + 1)]
    return list(zip(ends[:-1], ends[1:], strict=True))


def distances(columns: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (row, entry) of one part: `columns` by place and row, `entries` by entry and place."""
    out = np.zeros((columns.shape[1], len(entries)), np.int64)
    for place in range(len(columns)):
        apart = columns[place][:, None] - entries[None, :, place]
        out += apart * apart
    return out


def _seeds(blocks, n: int, entries: int, depth: int) -> list[list[int]]:
    """The vectors of the smallest different ids, ascending."""

    def least(found: dict) -> dict:
        return {i: found[i] for i in sorted(found)[:entries]}

    def merge(a: dict, b: dict) -> dict:
        out = dict(a)
        for i, v in b.items():
            out[i] = min(out.get(i, v), v)
        return least(out)

    def add(found: dict, block) -> dict:
        columns = None
        own: dict = {}
        known = [(i, row) for row, i in enumerate(block["ids"]) if i is not None]
        allowed = set(sorted({i for i, _ in known})[:entries])
        for i, row in known:
            if i in allowed:
                columns = _columns(block["columns"], block["width"], n) if columns is None else columns
                v = columns[:, row].tolist()
                own[i] = min(own.get(i, v), v)
        return merge(found, own)

    return [v for _, v in sorted(blocks.treeAggregate({}, add, merge, depth).items())]


def _round(blocks, n: int, codebooks: list[np.ndarray], cuts: list[tuple[int, int]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums (part, entry, place) and counts (part, entry) of the rows nearest to each entry."""
    places, size = max(b - a for a, b in cuts), len(codebooks[0])

    def add(total, block):
        if total is None:
            total = np.zeros((len(cuts), size, places), np.int64), np.zeros((len(cuts), size), np.int64)
        sums, counts = total
        columns = _columns(block["columns"], block["width"], n)
        for part, (a, b) in enumerate(cuts):
            code = distances(columns[a:b], codebooks[part]).argmin(axis=1)
            for place in range(b - a):
                np.add.at(sums[part, :, place], code, columns[a + place])
            np.add.at(counts[part], code, 1)
        return total

    def merge(x, y):
        if x is None or y is None:
            return y if x is None else x
        return x[0] + y[0], x[1] + y[1]

    return blocks.treeAggregate(None, add, merge, depth)


def train(blocks: DataFrame, n: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """The codebook (entry, place) of each part."""
    rdd = blocks.rdd
    cuts = parts_of(n, parts)
    depth = max(2, math.ceil(math.log(max(2, rdd.getNumPartitions()), FAN)))
    seeds = np.array(_seeds(rdd, n, entries, depth), np.int64).reshape(-1, n)
    codebooks = [seeds[:, a:b].copy() for a, b in cuts]
    for _ in range(rounds if len(seeds) else 0):
        sums, counts = _round(rdd, n, codebooks, cuts, depth)
        for part, (a, b) in enumerate(cuts):
            used = counts[part] > 0
            codebooks[part][used] = sums[part][used, : b - a] // counts[part][used, None]
    return codebooks


def _assigned(n: int, codebooks: list[np.ndarray], cuts: list[tuple[int, int]]):
    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                columns = _columns(batch.column("columns")[i].as_py(), batch.column("width")[i].as_py(), n)
                codes, error = np.zeros((columns.shape[1], len(cuts)), np.uint8), np.zeros(columns.shape[1], np.int64)
                for part, (a, b) in enumerate(cuts):
                    apart = distances(columns[a:b], codebooks[part])
                    codes[:, part] = apart.argmin(axis=1)
                    error += apart.min(axis=1)
                text = codes.tobytes().hex()
                step = 2 * len(cuts)
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values, batch.column("labels")[i].values, pa.array([text[k : k + step] for k in range(0, len(text), step)]), pa.array(error)], names=["vec_id", "label", "code", "error"])

    return run


def _with_totals(coded: DataFrame) -> DataFrame:
    """label_error: the error summed over the rows of the same label, nulls together."""
    key = F.struct(F.col("label"))
    totals = coded.groupBy(key.alias("own")).agg(F.sum("error").alias("label_error"))
    totals = cut(totals)
    if totals.limit(LABELS + 1).count() <= LABELS:
        return coded.withColumn("own", key).join(F.broadcast(totals), "own").drop("own")
    salted = totals.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return coded.withColumn("own", key).withColumn("salt", F.pmod(F.hash("vec_id", "error"), F.lit(SALTS))).join(salted, ["own", "salt"]).drop("own", "salt")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error, label_error for each vector that takes part; the codebook of each part).

    `code` has two hex digits for each part, so there are at most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has one byte for each part: 1 to 256 entries")
    spark = vectors.sparkSession
    rows, n = _taking_part(vectors)
    if not n:
        return spark.createDataFrame([], "vec_id long, label string, code string, error long, label_error long"), []
    blocks = cut(_blocks(rows, n, scale))
    codebooks, cuts = train(blocks, n, parts, entries, rounds), parts_of(n, parts)
    if not len(codebooks[0]):
        raise ValueError("no vector has an id, so nothing can seed the codebooks")
    coded = blocks.mapInArrow(textkit.tidy(_assigned(n, codebooks, cuts)), "vec_id long, label string, code string, error long")
    return _with_totals(cut(coded)), codebooks


def digest(codebooks: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in codebooks for x in book.ravel().tolist()).encode()).hexdigest()


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, codebooks = compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """The same in DuckDB: a part's components stand in one list, each round is one step."""
    bad = "x IS NULL OR NOT isfinite(x)"
    steps = [
        f"""r AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {scale}) AS BIGINT)) AS v FROM embeddings
        WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: {bad})) = 0)""",
        f"p AS MATERIALIZED (SELECT vec_id, label, k AS part, v[k * (len(v) // {parts}) + 1 : (k + 1) * (len(v) // {parts})] AS x FROM r, range({parts}) t(k))",
        f"s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM r QUALIFY entry < {entries})",
        "c0 AS MATERIALIZED (SELECT part, entry, x AS c FROM p JOIN s USING (vec_id))",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (SELECT vec_id, label, part, x, min({{'d': d, 'e': entry}}) AS best FROM (
            SELECT vec_id, label, part, x, entry, CAST(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM p JOIN c{k} USING (part))
            GROUP BY vec_id, label, part, x)"""
        )
        if k < rounds:
            steps.append(
                f"""m{k} AS (SELECT part, entry, list(mean ORDER BY place) AS c FROM (
                SELECT part, entry, place, CAST((t - ((t % n) + n) % n) // n AS BIGINT) AS mean FROM (
                SELECT part, best.e AS entry, place, sum(y) AS t, count(*) AS n FROM (SELECT part, best, unnest(x) AS y, unnest(range(len(x))) AS place FROM a{k}) GROUP BY ALL)) GROUP BY part, entry)"""
            )
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN m{k} USING (part, entry))")
    steps.append(f"g AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})")
    steps.append(f"o AS (SELECT vec_id, label, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id, label)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM o, g"


OP13_SQL = _sql()
