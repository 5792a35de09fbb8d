"""Runs that compute only what is new, and the file stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def misses(rows: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Rows whose key isn't stored; null keys are always new."""
    return rows.join(stored.select(key).distinct(), key, "left_anti")


def cache_key(content: str, fingerprint: str, variant: str):
    """sha-256 over content, build fingerprint and variant."""
    return F.sha2(F.concat(F.col(content), F.lit(f"|{fingerprint}|{variant}").cast("binary")), 256)


def file_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a directory, as they come: path, modificationTime, length, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)


def new_contents(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row of each content within the delay: state is kept by hash and dropped when the watermark passes."""
    return stream.withColumn("key", F.sha2("content", 256)).withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["key"])


def bursts(releases: DataFrame, window: str = "24 hours", slide: str = "1 hour", delay: str = "2 days") -> DataFrame:
    """Releases of a package in sliding windows of its timeline (package, at timestamp)."""
    return releases.withWatermark("at", delay).groupBy(F.window("at", window, slide), "package").agg(F.count(F.lit(1)).alias("releases"))
