"""Joins and counts of intervals [start, end) within keys, for keys of any size.  Bounds are whole numbers; intervals without length meet nothing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a level are so many times as wide as those of the level below.
STEP = 4
#: Stretches of values that a key's counts are dealt out in.
STRETCHES = 1024


def _level(length: Column) -> Column:
    """The lowest level whose cells are as wide as an interval, so that it touches two of them at most."""
    return F.greatest(F.ceil(F.ln(length.cast("double")) / math.log(STEP) - 1e-9), F.lit(0)).cast("int")


def _width(level: Column) -> Column:
    return F.pow(F.lit(float(STEP)), level).cast("long")


def _cells(rows: DataFrame, start: str, end: str, above: list[int], own: bool) -> DataFrame:
    """rows once for each cell that they touch: at their own level, or at all of the levels `above` that are higher."""
    level = _level(F.col(end) - F.col(start))
    levels = F.array(level) if own else F.filter(F.array(*(F.lit(x) for x in above)), lambda x: x > level)
    rows = rows.withColumn("_level", F.explode(levels)).withColumn("_from", F.floor(F.col(start) / _width(F.col("_level")))).withColumn("_to", F.floor((F.col(end) - 1) / _width(F.col("_level"))))
    return rows.withColumn("_cell", F.explode(F.sequence("_from", "_to"))).drop("_from", "_to")


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str]) -> DataFrame:
    """Pairs of rows of the same keys whose intervals share a point, each once; the columns of both sides but the right's keys.

    An interval lies at the level whose cells are about as wide as itself, and is looked for at its level and all higher
    ones of the other side, so a short one meets a long one in the long one's cells, and rows that meet in a cell mostly
    overlap.  A key's rows are dealt out by cells; nothing is held against all of a key.
    """
    (s1, e1), (s2, e2) = left_bounds, right_bounds
    left, right = left.filter(F.col(e1) > F.col(s1)), right.filter(F.col(e2) > F.col(s2))
    right = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    own = [f"_{k}" for k in keys]
    levels = lambda df, s, e: sorted(r[0] for r in df.select(_level(F.col(e) - F.col(s)).alias("l")).distinct().collect())  # noqa: E731  # 32 at most
    in_left, in_right = levels(left, s1, e1), levels(right, s2, e2)
    # the left's rows at the levels of right ones that are at least as long, and the other way round but for equal levels;
    # rows of levels that the other side lacks go before the join, and what no row can be in isn't made
    at = lambda df, s, e, other: df.filter(_level(F.col(e) - F.col(s)).isin(other))
    sides = []
    if set(in_left) & set(in_right):
        sides.append((_cells(at(left, s1, e1, in_right), s1, e1, [], True), _cells(at(right, s2, e2, in_left), s2, e2, [], True)))
    for short, long in ((in_left, in_right), (in_right, in_left)):
        met = sorted({x for x in long if x > min(short, default=x)})
        if met and short is in_left:
            sides.append((_cells(left, s1, e1, met, False), _cells(at(right, s2, e2, met), s2, e2, [], True)))
        elif met:
            sides.append((_cells(at(left, s1, e1, met), s1, e1, [], True), _cells(right, s2, e2, met, False)))
    both = []
    for a, b in sides or [(_cells(left, s1, e1, [], True), _cells(right, s2, e2, [], True))]:
        b = b.withColumnsRenamed({"_level": "_l", "_cell": "_c"})
        same = (F.col("_level") == F.col("_l")) & (F.col("_cell") == F.col("_c"))
        for k, other in zip(keys, own, strict=True):
            same = same & (F.col(k) == F.col(other))
        met = a.join(b, same & (F.col(s1) < F.col(e2)) & (F.col(s2) < F.col(e1)))
        # a pair that shares several cells is given in the one of its first common point
        first = F.floor(F.greatest(F.col(s1), F.col(s2)) / _width(F.col("_level")))
        both.append(met.filter(first == F.col("_cell")).drop("_level", "_cell", "_l", "_c", *own))
    return reduce(DataFrame.unionByName, both)


def counts_below(points: DataFrame, asked: DataFrame, keys: list[str], value: str, id_: str) -> DataFrame:
    """(id, n): for each row of asked (keys, value, id) how many points (keys, value) of its keys are smaller.

    Values are cut into stretches; points are counted within a row's stretch, and the stretches before by sums of stretches.
    """
    from pyspark.sql import Window as W

    rows = points.select(*keys, F.col(value).cast("long").alias("_v"), F.lit(None).cast("string").alias("_id"), F.lit(1).alias("_one"))
    rows = rows.unionByName(asked.select(*keys, F.col(value).cast("long").alias("_v"), F.col(id_).cast("string").alias("_id"), F.lit(0).alias("_one")))
    range_ = points.agg(F.min(value).cast("long"), F.max(value).cast("long")).first()
    low, high = range_[0] or 0, range_[1] or 0
    width = max(1, (high - low) // STRETCHES + 1)
    rows = rows.withColumn("_cell", F.greatest(F.least(F.floor((F.col("_v") - low) / width), F.lit(STRETCHES)), F.lit(-1)))
    inside = F.sum("_one").over(W.partitionBy(*keys, "_cell").orderBy("_v").rangeBetween(W.unboundedPreceding, -1))
    sums = rows.groupBy(*keys, "_cell").agg(F.sum("_one").alias("_sum"))
    before = F.sum("_sum").over(W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(*keys, "_cell", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(sums, [*keys, "_cell"]).filter("_id IS NOT NULL")
    return out.select(F.col("_id").cast(asked.schema[id_].dataType).alias(id_), (F.col("_inside") + F.col("_before")).alias("n"))


def overlap_counts(asked: DataFrame, others: DataFrame, keys: list[str], bounds: tuple[str, str], id_: str) -> DataFrame:
    """(id, n): how many intervals of others (keys, bounds) each of asked (keys, bounds, id) shares a point with, without pairs.

    Those that begin before its end, less those that end at its beginning or before.
    """
    start, end = bounds
    asked, others = asked.filter(F.col(end) > F.col(start)), others.filter(F.col(end) > F.col(start))
    begun = counts_below(others.select(*keys, F.col(start).alias("_b")), asked.select(*keys, F.col(end).alias("_b"), id_), keys, "_b", id_)
    over = counts_below(others.select(*keys, (F.col(end) - 1).alias("_b")), asked.select(*keys, F.col(start).alias("_b"), id_), keys, "_b", id_)
    return begun.join(over.withColumnRenamed("n", "_n"), id_).select(id_, (F.col("n") - F.col("_n")).alias("n"))
