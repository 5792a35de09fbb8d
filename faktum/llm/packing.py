"""Vector best-fit packing of documents into sequences.

A document becomes its token ids and an end id.  One that is longer than a
sequence is cut into pieces of full length, of which the first may be shorter.
A piece asks for (tokens, one document, attention cost = tokens squared); a
sequence has a capacity in each, and a piece goes to the open sequence that
admits it in every dimension and scores best: by the weighted dot product of
the piece and what the sequence has left, or by the norm of what would remain.

What a piece asks for depends on its length alone, so the plan is made from
the histogram of lengths: at most one row for each length up to the capacity,
however many documents there are.  Equal sequences are planned together as one
class with a multiplicity.  Each piece then finds its place by its rank among
the pieces of its length; ranks are dealt by hash parts, so no length's pieces
meet in one task.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.llm.byte_bpe import ByteBpe, default_path
from faktum.llm import textkit
from faktum.llm.storage import cut, table

CAPACITY = 2048
END_ID = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence; None: without bound.  Weights are those of tokens, documents and attention cost."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.25, 0.5)
    rule: str = "norm"  # or "dot"


@dataclass
class Plan:
    """kinds[k] = (lengths in order, number of sequences); sequences are numbered kind by kind."""

    kinds: list[tuple[tuple[int, ...], int]] = field(default_factory=list)


class _Open:
    """Classes of equal open sequences: what each has left, how many there are, and the lengths they hold."""

    def __init__(self, scale: np.ndarray, rule: str):
        self.scale, self.rule = scale, rule
        self.room = np.zeros((64, 3), np.int64)
        self.count = np.zeros(64, np.int64)
        self.lengths: list[tuple[int, ...]] = []

    def add(self, room: np.ndarray, count: int, lengths: tuple[int, ...]) -> None:
        n = len(self.lengths)
        if n == len(self.count):
            live = np.flatnonzero(self.count)
            self.lengths = [self.lengths[i] for i in live]
            size = max(64, 2 * len(live))
            room_, count_ = np.zeros((size, 3), np.int64), np.zeros(size, np.int64)
            room_[: len(live)], count_[: len(live)] = self.room[live], self.count[live]
            self.room, self.count, n = room_, count_, len(live)
        self.room[n], self.count[n] = room, count
        self.lengths.append(lengths)

    def best(self, need: np.ndarray) -> int | None:
        """The class that admits `need` in every dimension and scores best, if there is one."""
        n = len(self.lengths)
        fits = np.flatnonzero((self.count[:n] > 0) & (self.room[:n] >= need).all(axis=1))
        if not len(fits):
            return None
        if self.rule == "dot":
            worth = -((self.room[fits] * self.scale) @ (need * self.scale))
        else:
            worth = (((self.room[fits] - need) * self.scale) ** 2).sum(axis=1)
        return int(fits[np.argmin(worth)])


def plan(histogram: dict[int, int], limits: Limits) -> Plan:
    """Best fit in decreasing order of length."""
    whole = np.array([limits.tokens, limits.documents or limits.tokens, limits.attention or limits.tokens**2], np.int64)
    open_, done = _Open(np.array(limits.weights) / whole, limits.rule), []
    for length in sorted((n for n, c in histogram.items() if c), reverse=True):
        need, left = np.array([length, 1, length * length], np.int64), histogram[length]
        if (need > whole).any():
            raise ValueError(f"a piece of {length} tokens exceeds a sequence's capacities")
        while left:
            at = open_.best(need)
            if at is None:
                each = int((whole // need).min())
                for k, count in ((each, left // each), (left % each, 1)):
                    if k and count:
                        open_.add(whole - k * need, count, (length,) * k)
                break
            take = min(int(open_.count[at]), left)
            open_.count[at] -= take
            left -= take
            room, lengths = open_.room[at] - need, (*open_.lengths[at], length)
            if (room <= 0).any():
                done.append((lengths, take))
            else:
                open_.add(room, take, lengths)
    done += [(open_.lengths[i], int(open_.count[i])) for i in np.flatnonzero(open_.count[: len(open_.lengths)])]
    return Plan(done)


def _places(made: Plan) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): pieces of a length, by rank, to places."""
    ranks: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for lengths, count in made.kinds:
        offset = 0
        for length in lengths:
            out.append((length, ranks[length], ranks[length] + count, sequence, offset))
            ranks[length] += count
            offset += length
        sequence += count
    return out


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])
#: The pieces of one length are ranked in parts of about this many, and in LEAST_PARTS at least.
PART_ROWS, LEAST_PARTS = 100_000, 64


def _pieces(path: str, capacity: int):
    def cut_up(batches):
        bpe = ByteBpe.of(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[] for _ in PIECES]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = bpe.encode_bytes(text.as_py() or "") + end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k in range(len(bounds) - 1):
                    crc = zlib.crc32(ids[4 * bounds[k] : 4 * bounds[k + 1]])
                    for into, x in zip(out, (doc_id, k, bounds[k], bounds[k + 1] - bounds[k], crc), strict=True):
                        into.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, PIECES, strict=True)], schema=PIECES)
        bpe.clear()

    return cut_up


def _place(shared):
    def place(batches):
        key, first, sequence, offset = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            at = np.searchsorted(key, (batch.column("length").to_numpy() << 44) + rank, "right") - 1
            own = [pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in PIECES.names), *own], schema=PACKED)

    return place


def pack(docs: DataFrame, limits: Limits = Limits(), path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs (doc_id, text).

    Null texts are empty and come out as their end id; null doc_ids are packed like any other; rows that repeat are
    packed as often as they occur.  An empty table gives an empty result; other columns are never read.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    longest = min(limits.tokens, int(limits.attention**0.5) if limits.attention else limits.tokens)
    pieces = cut(docs.mapInArrow(textkit.tidy(_pieces(path or default_path(), longest)), PIECES_DDL))
    histogram = {x["length"]: x["count"] for x in pieces.groupBy("length").count().collect()}  # a row for each length at most
    places = np.array(sorted(_places(plan(histogram, limits))), np.int64).reshape(-1, 5)
    shared = spark.sparkContext.broadcast(((places[:, 0] << 44) + places[:, 1], places[:, 1], places[:, 3], places[:, 4]))
    parts = max(LEAST_PARTS, sum(histogram.values()) // PART_ROWS)
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = pieces.groupBy("length", "part").count().select("length", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(offsets, ["length", "part"])
    own = W.partitionBy("length", "part").orderBy("doc_id", "piece")
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(own) - 1)
    return ranked.select(*PIECES.names, F.col("rank").cast("long").alias("rank")).mapInArrow(textkit.tidy(_place(shared)), PIECES_DDL + ", sequence_id long, offset long")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
