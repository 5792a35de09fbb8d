"""The queries: each a function of (spark, directory of tables), some with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function as a query under its name."""

    def register(f: Query) -> Query:
        own = name or f.__name__
        QUERIES[own] = f
        if sql is not None:
            ORACLES[own] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes a task that Spark's own splits are left alone from; bytes of files a task where what is made of them is far larger or heavier.
A_TASK, A_STEP = 64 << 20, 4 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over as many tasks as the cluster runs at once, for work that is heavier than its input.

    A small table may lie in one row group, and then in one task, however many splits are made; a large one, by the size
    that the plan knows, has more row groups than tasks and stays as it is.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(n) if size < n * A_TASK else df


def dealt(df: DataFrame, *by: str, of: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df by keys over as many tasks as heavy work on what follows needs, by the size of its files and of those of `of`.

    What is made after a join or a grouping is larger than what it reads, so the tasks that Spark would make by bytes are
    too few; both sides of a join are dealt with the same `of`, and then meet as they are.
    """
    size = 0
    for x in (df, *of):
        leaves = x._jdf.queryExecution().optimizedPlan().collectLeaves()
        size += sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, size // A_STEP), *by)


def rows(spark: SparkSession, schema: str, *values: tuple) -> DataFrame:
    return spark.createDataFrame(list(values), schema)


def literal(value) -> str:
    """A value in DuckDB's SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return repr(value)
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    if isinstance(value, bytes):
        return "'" + "".join(f"\\x{b:02x}" for b in value) + "'::BLOB"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def values(columns: str, *data: tuple) -> str:
    """A DuckDB table expression of literal rows, as `t(columns)`."""
    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in data) + f") AS t({columns})"


_ORD = "l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey"


def lines_sql(columns: str, *cases: tuple) -> str:
    """Typed rows, and files made of orders: each line of an order is one of the typed rows, by its part, under the order's number (and an `ord` of its own)."""
    names = columns.split(", ")
    text = isinstance(cases[0][0], str)
    own = [("'o' || l_orderkey" if text else "1000 + l_orderkey") if k == 0 else _ORD if n == "ord" else f"c.{n}" for k, n in enumerate(names)]
    numbered = ", ".join("(" + ", ".join(map(literal, (k, *r))) + ")" for k, r in enumerate(cases))
    made = ", ".join(f"{x} AS {n}" for x, n in zip(own, names, strict=True))
    return f"(SELECT * FROM {values(columns, *cases)} UNION ALL SELECT {made} FROM lineitem JOIN (VALUES {numbered}) AS c(k, {columns}) ON l_partkey % {len(cases)} = c.k) AS t"


def lines(spark: SparkSession, sf_dir: str, schema: str, *cases: tuple) -> DataFrame:
    """The same as a DataFrame."""
    from pyspark.sql import functions as F

    typed = rows(spark, schema, *cases)
    first, *others = typed.columns
    numbered = F.broadcast(rows(spark, "_k long, " + schema, *((k, *r) for k, r in enumerate(cases))))
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("long").alias("_n"))
    met = line.join(numbered, F.col("l_partkey") % len(cases) == F.col("_k"))
    own = F.concat(F.lit("o"), "l_orderkey") if isinstance(cases[0][0], str) else F.lit(1000) + F.col("l_orderkey")
    place = F.col("_n") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    wide = typed.select(F.col(first).cast("string" if isinstance(cases[0][0], str) else "long").alias(first), *(F.col(c).cast("long").alias(c) if c == "ord" else F.col(c) for c in others))
    return wide.unionByName(met.select(own.alias(first), *(place.alias(c) if c == "ord" else F.col(c) for c in others)))
