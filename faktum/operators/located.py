"""Places in contents: offsets of chunks, runs of spans, and bounded lists of them, for keys of any size.

A content may be many rows (key, order, bytes).  No operator here puts all rows
of a key into one task: rows meet by key and a stretch of the order or of the
offsets, and only sums or border runs of stretches meet by key.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.functions import bytes as B
from faktum.functions.bytes import TOLERANCE, WINDOW

#: Rows of a side that is broadcast, at most; beyond it the join is salted so often.
BROADCAST, SALTS = 100_000, 32
#: Order values of a group, and groups of a group, in prefix sums; bytes of a stretch in which runs are found.
FAN, STRETCH = 4096, 1 << 24
#: Spans of a list, at most.
CAP = 64


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the one row of `totals` that has the same keys (nulls match); a key may have any share of the rows."""
    if totals.limit(BROADCAST + 1).count() <= BROADCAST:
        side, salted = F.broadcast(totals), rows
        on = []
    else:
        side = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
        on = ["_salt"]
    renamed = reduce(lambda df, k: df.withColumnRenamed(k, f"_{k}"), [*keys, *on], side)
    same = reduce(lambda a, b: a & b, (salted[k].eqNullSafe(renamed[f"_{k}"]) for k in [*keys, *on]))
    return salted.join(renamed, same).drop(*(f"_{k}" for k in [*keys, *on]), *on)


def offsets(rows: DataFrame, keys: list[str], order: str, size: Column, levels: int = 1, name: str = "offset") -> DataFrame:
    """rows with the sum of `size` over the rows before, by `order` (whole numbers, different within a key).

    Rows are summed by groups of FAN order values, and with `levels` of 2 or more those by groups of FAN, and so on; only
    the last sums are one window a key.  Sums and rows are dealt out by the same key and group, so they meet without a further shuffle.
    """
    rows = rows.withColumn("_size", F.coalesce(size, F.lit(0)).cast("long")).withColumn("_group", F.floor(F.col(order) / FAN))
    inside = F.coalesce(F.sum("_size").over(W.partitionBy(*keys, "_group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy(*keys, "_group").agg(F.sum("_size").alias("_sum"))
    if levels > 1:
        based = offsets(sums.withColumnRenamed("_group", f"_order{levels}"), keys, f"_order{levels}", F.col("_sum"), levels - 1, f"_start{levels}")
        based = based.withColumnsRenamed({f"_order{levels}": "_group", f"_start{levels}": "_start"})
    else:
        before = W.partitionBy(*keys).orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
        based = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(before), F.lit(0)))
    based = reduce(lambda df, k: df.withColumnRenamed(k, f"_{k}"), [*keys, "_group"], based.select(*keys, "_group", "_start"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys), F.col("_group").eqNullSafe(F.col("__group")))
    out = rows.withColumn("_inside", inside).join(based, same)
    return out.withColumn(name, F.col("_inside") + F.col("_start")).drop("_size", "_group", "_inside", "_start", "__group", *(f"_{k}" for k in keys))


def runs(spans: DataFrame, keys: list[str], offset: str = "offset", length: str = "len", stretch: int = STRETCH) -> DataFrame:
    """(keys, offset, len): spans by offset, where one that begins where the one before ends extends it; empty ones go.

    Runs are found in each stretch of offsets; the first and the last run of a stretch may go on in its neighbours, and
    only these meet by key.
    """
    own = spans.filter(F.col(length) > 0).select(*keys, F.floor(F.col(offset) / stretch).alias("_cell"), F.col(offset).alias("offset"), F.col(length).alias("len"))
    by = W.partitionBy(*keys, "_cell").orderBy("offset", "len")
    own = own.withColumn("_new", ~F.lag(F.col("offset") + F.col("len")).over(by).eqNullSafe(F.col("offset"))).withColumn("_run", F.sum(F.col("_new").cast("long")).over(by))
    found = own.groupBy(*keys, "_cell", "_run").agg(F.min("offset").alias("offset"), F.sum("len").alias("len"))
    found = found.withColumn("_edge", (F.col("_run") == 1) | (F.col("_run") == F.max("_run").over(W.partitionBy(*keys, "_cell"))))
    along = W.partitionBy(*keys).orderBy("_cell", "_run")
    edges = found.filter("_edge").withColumn("_new", ~F.lag(F.col("offset") + F.col("len")).over(along).eqNullSafe(F.col("offset")))
    # two runs of one stretch never touch, so a chain goes over stretches only
    edges = edges.withColumn("_chain", F.sum(F.col("_new").cast("long")).over(along)).groupBy(*keys, "_chain").agg(F.min("offset").alias("offset"), F.sum("len").alias("len"))
    return found.filter("NOT _edge").select(*keys, "offset", "len").unionByName(edges.select(*keys, "offset", "len"))


def listed(found: DataFrame, keys: list[str], cap: int = CAP, by_size: bool = False) -> DataFrame:
    """(keys, spans, n_runs, covered): of each key the first `cap` runs by offset, or the longest ones, and all in number and bytes.

    Lists are cut within each partition before they meet, and once more after.
    """
    own = [F.desc("len"), F.asc("offset")] if by_size else [F.asc("offset")]
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*own))
    first = found.withColumn("_place", place).filter(F.col("_place") <= cap)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_place", "offset", "len"))).alias("_s"))
    shown = shown.select(*keys, F.transform("_s", lambda x: F.struct(x["offset"].alias("offset"), x["len"].alias("len"))).alias("spans"))
    total = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_runs"), F.sum("len").alias("covered"))
    same = reduce(lambda a, b: a & b, (shown[k].eqNullSafe(total[k]) for k in keys))
    return shown.join(total, same).select(*(shown[k] for k in keys), "spans", "n_runs", "covered")


def _chunk(content: pa.Array, base: pa.Array) -> pa.Array:
    """Of each chunk its histogram, the entropies of windows that lie in it whole, and the counts of those that it shares, for a column at once."""
    raw, offsets = B.flat(content)
    at, n = base.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(offsets)
    head = np.minimum(-at % WINDOW, n)
    whole = (n - head) // WINDOW
    tail = n - head - whole * WINDOW

    def counted(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = [(k + row, byte, h[row, byte]) for k, h in B.histograms(raw, starts, ends) for row, byte in (np.nonzero(h),)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *(x[i] for x in found)]) for i in range(3))

    piece, byte, k = counted(offsets[:-1], offsets[1:])
    counts = B.listed(np.bincount(piece, minlength=len(n)), byte=byte.astype(np.int32), n=k)
    of = np.repeat(np.arange(len(n)), whole)
    place = np.arange(len(of)) - np.repeat(np.cumsum(whole) - whole, whole)
    starts = (offsets[:-1] + head)[of] + place * WINDOW
    entropy = np.concatenate([np.zeros(0), *(B.entropies(h) for _, h in B.histograms(raw, starts, starts + WINDOW))])
    inside = B.listed(whole, window=((at + head) // WINDOW)[of] + place, entropy=entropy)
    ends = np.stack([offsets[:-1], offsets[1:] - tail], axis=1).ravel()  # the head and the tail of each chunk, in order
    piece, byte, k = counted(ends, ends + np.stack([head, tail], axis=1).ravel())
    window = np.stack([at // WINDOW, (at + n - tail) // WINDOW], axis=1).ravel()[piece]
    shared = B.listed(np.bincount(piece // 2, minlength=len(n)), window=window, byte=byte.astype(np.int32), n=k)
    return pa.StructArray.from_arrays([counts, inside, shared], ["counts", "whole", "shared"])


_COUNTS = "array<struct<byte:int,n:bigint>>"


def _bits(n: Column, size: Column) -> Column:
    return F.log2(size) - F.sum(n * F.log2(n)) / size


def windows(chunks: DataFrame, keys: list[str], order: str, content: str) -> tuple[DataFrame, DataFrame]:
    """((keys, window, size, entropy) of the windows of contents that lie in chunks, (keys, overall, size) of whole contents).

    Windows go over chunk borders, and the results are the same however a content is cut: a window inside a chunk is
    measured there, one that chunks share by adding up their counts.  Entropies have 9 digits, so that the order in which
    they are summed doesn't show.
    """
    facts = F.arrow_udf(_chunk, f"counts {_COUNTS}, whole array<struct<window:bigint,entropy:double>>, shared array<struct<window:bigint,byte:int,n:bigint>>")
    placed = offsets(chunks.select(*keys, order, content), keys, order, F.octet_length(content))
    own = placed.select(*keys, facts(F.col(content), F.col("offset")).alias("_f"))
    whole = own.select(*keys, F.inline("_f.whole")).select(*keys, "window", F.lit(WINDOW).cast("long").alias("size"), "entropy")
    parts = own.select(*keys, F.inline("_f.shared")).groupBy(*keys, "window", "byte").agg(F.sum("n").alias("n"))
    size = F.sum("n")
    shared = parts.groupBy(*keys, "window").agg(size.alias("size"), _bits(F.col("n"), size).alias("entropy"))
    level = whole.unionByName(shared).withColumn("entropy", F.round("entropy", 9) + F.lit(0.0))
    counted = own.select(*keys, F.inline("_f.counts")).groupBy(*keys, "byte").agg(F.sum("n").alias("n"))
    total = counted.groupBy(*keys).agg((F.round(_bits(F.col("n"), size), 9) + F.lit(0.0)).alias("overall"), size.alias("size"))
    return level, total


def peak_regions(chunks: DataFrame, keys: list[str], order: str, content: str) -> DataFrame:
    """(keys, overall, size, peak, spans by size, n_runs, covered) of contents in chunks; contents without bytes are left out."""
    level, total = windows(chunks, keys, order, content)
    # dealt out once, as runs need it; the peaks come from the same exchange
    level = level.repartition(*keys, F.floor(F.col("window") * WINDOW / STRETCH))
    peaks = level.groupBy(*keys).agg(F.max("entropy").alias("peak"))
    high = join_totals(level, peaks, keys).filter(F.col("entropy") >= F.round(F.col("peak") - TOLERANCE, 9))
    found = listed(runs(high.select(*keys, (F.col("window") * WINDOW).alias("offset"), F.col("size").alias("len")), keys), keys, by_size=True)
    for side in (peaks, total):
        side = reduce(lambda df, k: df.withColumnRenamed(k, f"_{k}"), keys, side)
        found = found.join(side, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))).drop(*(f"_{k}" for k in keys))
    return found.select(*keys, "overall", "size", "peak", "spans", "n_runs", "covered")


_TEXT = np.zeros(256, bool)
_TEXT[[9, *range(0x20, 0x7F)]] = True


#: Bytes of a string, at least.
LEAST = 4


def _strings_of(values: pa.Array) -> pa.Array:
    """Runs are found over the bytes of all values, ended where a value ends."""
    raw, offsets = B.flat(values)
    n = np.diff(offsets)
    inside = np.zeros(offsets[-1] - offsets[0] + len(n), bool)  # with a place that is no text behind each value
    inside[np.arange(offsets[-1] - offsets[0]) + np.repeat(np.arange(len(n)), n)] = _TEXT[raw[offsets[0] : offsets[-1]]]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))).reshape(-1, 2)
    edges = edges[edges[:, 1] - edges[:, 0] >= LEAST]
    of = np.searchsorted(offsets[1:] - offsets[0] + np.arange(len(n)), edges[:, 0])
    start, size = edges[:, 0] - of + offsets[0], edges[:, 1] - edges[:, 0]
    entropy = np.concatenate([np.zeros(0), *(B.entropies(h) for _, h in B.histograms(raw, start, start + size))])
    return B.listed(np.bincount(of, minlength=len(n)), offset=(start - offsets[of]).astype(np.int64), len=size.astype(np.int64), entropy=entropy)


def _strings(values: pa.Array) -> pa.Array:
    return B.in_stretches(values, _strings_of)


def string_places(content: Column) -> Column:
    """(offset, len, entropy) of the runs of printable ASCII and tabs of at least LEAST bytes."""
    return F.arrow_udf(_strings, "array<struct<offset:bigint,len:bigint,entropy:double>>")(content)


def string_facts(chunks: DataFrame, keys: list[str], order: str, content: str, floor: float = 6.0) -> DataFrame:
    """(keys, string_count, max_string_length, max_offset, high_entropy_count, spans, n_runs) of the strings of contents in
    chunks, with the first of the longest, and where those of at least `floor` bits a byte stand.  A string ends with its chunk."""
    placed = offsets(chunks.select(*keys, order, content), keys, order, F.octet_length(content), name="_at")
    found = placed.select(*keys, "_at", F.inline(string_places(F.col(content)))).withColumn("offset", F.col("offset") + F.col("_at")).drop("_at")
    high = F.round("entropy", 9) >= floor
    longest = F.max(F.struct("len", (-F.col("offset")).alias("back")))
    facts = found.groupBy(*keys).agg(F.count(F.lit(1)).alias("string_count"), longest.alias("_l"), F.count_if(high).alias("high_entropy_count"))
    facts = facts.select(*keys, "string_count", F.col("_l.len").alias("max_string_length"), (-F.col("_l.back")).alias("max_offset"), "high_entropy_count")
    spans = listed(runs(found.filter(high), keys), keys)
    spans = reduce(lambda df, k: df.withColumnRenamed(k, f"_{k}"), keys, spans)
    return facts.join(spans, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left").drop(*(f"_{k}" for k in keys), "covered")
