"""Get or compute: facts by content key in Parquet, written by batches that a ledger knows.

    ROOT/version=V/data/batch=B/shard=SS/*.parquet
    ROOT/version=V/ledger/batch=B/

A batch is written whole into its own folder (written again, it overwrites it),
then its ledger entry.  Only batches in the ledger are read, so a batch that was
cut off between both leaves nothing behind, and one that comes twice changes
nothing.  Keys are looked up behind a Bloom filter of the stored ones: what it
rules out is computed without a join.  Results that are marked as transient are
given back and not stored.  All paths go through Hadoop's file systems.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Places of the Bloom filter, and how many a key sets.
PLACES, PROBES = 1 << 20, 4


class Store:
    def __init__(self, spark: SparkSession, root: str, version: int, key: str = "key"):
        self.spark, self.root, self.version, self.key = spark, root.rstrip("/"), version, key

    def _path(self, *parts: str) -> str:
        return "/".join([self.root, f"version={self.version}", *parts])

    def _fs(self, path: str):
        own = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return own.getFileSystem(self.spark._jsc.hadoopConfiguration()), own

    def _children(self, path: str) -> list[str]:
        fs, own = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(own)] if fs.exists(own) else []

    def batches(self) -> list[int]:
        """The batches that were finished."""
        return sorted(int(x.partition("=")[2]) for x in self._children(self._path("ledger")) if x.startswith("batch="))

    def facts(self) -> DataFrame | None:
        """What is stored; null while nothing is."""
        done = [self._path("data", f"batch={b}") for b in self.batches()]
        done = [x for x in done if any(y.startswith("shard=") for y in self._children(x))]
        return self.spark.read.option("basePath", self._path("data")).parquet(*done).drop("batch", "shard") if done else None

    def _bloom(self, stored: DataFrame) -> bytes:
        """PLACES bits, made of the partial filters of tasks."""
        key, size = self.key, PLACES // 64

        probes = F.array(*(F.pmod(F.xxhash64(F.col(key), F.lit(k)), F.lit(PLACES)) for k in range(PROBES)))
        spots = stored.select(F.explode(probes).alias("p")).distinct()

        def pack(batches):
            for batch in batches:
                for k, bits in zip(batch.column("k").to_pylist(), batch.column("bits"), strict=True):
                    flags = np.zeros(size, bool)
                    flags[bits.values.to_numpy()] = True
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(flags).tobytes()])], names=["k", "bits"])

        parts = spots.groupBy(F.floor(F.col("p") / size).alias("k")).agg(F.collect_list((F.col("p") % size).cast("int")).alias("bits"))
        out = [bytes(size // 8)] * 64
        for row in parts.mapInArrow(pack, "k long, bits binary").collect():
            out[row["k"]] = bytes(row["bits"])
        return b"".join(out)

    def _maybe(self, bits: bytes):
        """Whether a key may be stored: all its places are set."""
        held = F.lit(bits)
        out = F.lit(True)
        for k in range(PROBES):
            p = F.pmod(F.xxhash64(F.col(self.key), F.lit(k)), F.lit(PLACES))
            byte = F.conv(F.hex(F.substring(held, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            out = out & (F.call_function("shiftright", byte, (7 - p % 8).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return out

    def missing(self, rows: DataFrame) -> DataFrame:
        """Rows whose key isn't stored; one of each key.  Null keys are nothing that could be stored and go."""
        rows = rows.filter(F.col(self.key).isNotNull()).dropDuplicates([self.key])
        stored = self.facts()
        if stored is None:
            return rows
        maybe = self._maybe(self._bloom(stored))
        return rows.filter(~maybe).unionByName(rows.filter(maybe).join(stored.select(self.key), self.key, "left_anti"))

    def add(self, rows: DataFrame, batch: int, compute: Callable[[DataFrame], DataFrame]) -> None:
        """For foreachBatch: computes and stores what is missing.  `compute` gives the key, facts, and may give `transient`."""
        if batch in self.batches():
            return
        made = compute(self.missing(rows))
        if "transient" in made.columns:
            made = made.filter(~F.coalesce("transient", F.lit(False))).drop("transient")
        data = self._path("data", f"batch={batch}")
        made.withColumn("shard", F.substring(F.col(self.key), 1, 2)).repartition("shard").write.mode("overwrite").option("compression", "zstd").partitionBy("shard").parquet(data)
        self.spark.range(1).write.mode("overwrite").parquet(self._path("ledger", f"batch={batch}"))

    def get_or_compute(self, rows: DataFrame, batch: int, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The facts of all rows' keys: stored ones, and the others computed; also those that aren't stored, being transient."""
        keys = rows.select(self.key).distinct()
        fresh = compute(self.missing(rows)) if batch not in self.batches() else None
        temporary = fresh.filter("transient").drop("transient") if fresh is not None and "transient" in fresh.columns else None
        self.add(rows, batch, compute)
        stored = self.facts()
        own = stored.join(keys, self.key, "left_semi") if stored is not None else None
        if own is None or temporary is None:
            return own if temporary is None else temporary
        return own.unionByName(temporary)

    def prune(self) -> list[int]:
        """Removes what earlier versions stored; gives their numbers."""
        gone = []
        for name in self._children(self.root):
            number = name.removeprefix("version=")
            if name.startswith("version=") and number.isdigit() and int(number) < self.version:
                fs, own = self._fs(f"{self.root}/{name}")
                fs.delete(own, True)
                gone.append(int(number))
        return sorted(gone)


def run(store: Store, stream: DataFrame, compute: Callable[[DataFrame], DataFrame], checkpoint: str):
    """Stores the facts of a stream of rows with a key."""
    return stream.writeStream.foreachBatch(lambda rows, batch: store.add(rows, batch, compute)).option("checkpointLocation", checkpoint)




def scratch(spark: SparkSession) -> str:
    """A new folder that the whole cluster sees: below spark.checkpoint.dir, or on this machine if Spark runs on it alone."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the cluster shares")
    return tempfile.mkdtemp(prefix="faktum-")
