"""Touches of keys that count at most once in an interval: the first of a key, then each that comes an interval or more after the last that counted.

What counts depends on what counted before, so no window says it.  A key's state
is one time.  In a batch the rows of a key come sorted through one stream of
Arrow batches, and from a touch that counts the next one is found by bisection,
so a key of many rows costs memory for none of them.  In a stream the same step
runs on each micro-batch's times, the state lies in the state store, and a timer
clears it when a key has been left alone so long that it can't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000


def counted(times: np.ndarray, last: int | None, interval: int) -> list[int]:
    """Those of the sorted times (in microseconds) that count after `last`."""
    out = []
    k = 0 if last is None else int(np.searchsorted(times, last + interval))
    while k < len(times):
        out.append(int(times[k]))
        k = int(np.searchsorted(times, times[k] + interval))
    return out


def touches(rows: DataFrame, key: str, at: str, interval: int = DAY) -> DataFrame:
    """(key, at) of the touches that count; null times are none, null keys are one key."""
    kind = rows.schema[key].dataType
    own = rows.select(F.col(key).alias("key"), F.col(at).cast("timestamp").alias("at")).filter("at IS NOT NULL")
    own = own.repartition("key").sortWithinPartitions("key", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            if not len(batch):
                continue
            keys, times = batch.column("key"), batch.column("at").cast(pa.timestamp("us", "UTC")).cast(pa.int64()).to_numpy()
            codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.concatenate([[0], np.flatnonzero(codes[1:] != codes[:-1]) + 1])
            places, found = [], []
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(codes)], strict=True):
                own = (keys[lo].as_py(),)
                last = last if own == now else None
                now = own
                hits = counted(times[lo:hi], last, interval)
                last = hits[-1] if hits else last
                places += [lo] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), pa.array(found, pa.int64()).cast(pa.timestamp("us", "UTC"))], names=["key", "at"])

    schema = T.StructType([T.StructField("key", kind), T.StructField("at", T.TimestampType())])
    return own.mapInArrow(run, schema).select(F.col("key").alias(key), F.col("at").alias(at))


class Touches(StatefulProcessor):
    """The step on a micro-batch of one key; `keep` is how long after its last counted touch a key's state stays."""

    def __init__(self, key: str, at: str, interval: int, keep: int):
        self.key, self.at, self.interval, self.keep = key, at, interval, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = np.sort(np.concatenate([x[self.at].dropna().astype("datetime64[us]").to_numpy().astype(np.int64) for x in rows]))
        last = self.last.get()[0] if self.last.exists() else None
        hits = counted(times, last, self.interval)
        if hits:
            if last is not None:
                self.handle.deleteTimer((last + self.keep) // 1000)
            self.handle.registerTimer((hits[-1] + self.keep) // 1000)
            self.last.update((hits[-1],))
            yield pd.DataFrame({self.key: [key[0]] * len(hits), self.at: pd.to_datetime(hits, unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def touch_stream(rows: DataFrame, key: str, at: str, interval: int = DAY, keep: int = 30 * DAY, delay: str = "1 hour") -> DataFrame:
    """The same over a stream in the order of its times (late ones within a micro-batch are sorted in); needs a state store
    with column families, as RocksDB's provider is.  `keep` has to be as long as the interval at least."""
    if keep < interval:
        raise ValueError("a key's state has to stay for the interval")
    schema = T.StructType([T.StructField(key, rows.schema[key].dataType), T.StructField(at, T.TimestampType())])
    own = rows.select(key, at).filter(F.col(at).isNotNull()).withWatermark(at, delay)
    return own.groupBy(key).transformWithStateInPandas(Touches(key, at, interval, keep), schema, "append", "EventTime")
