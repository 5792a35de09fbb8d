"""Files as rows: path, basename, content, length, modificationTime, forced_type, file_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faktum.operators.identify import basename


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Every regular file below a path; path, length and time are filtered before contents are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return shaped(files)


def shaped(files: DataFrame, forced: Column | None = None) -> DataFrame:
    """Adds what is missing of the columns of a file."""
    add = {
        "path": F.lit(""),
        "length": F.octet_length("content").cast("long"),
        "modificationTime": F.lit(None).cast("timestamp"),
        "forced_type": F.lit(None).cast("string") if forced is None else forced,
    }
    for name, value in add.items():
        if name not in files.columns:
            files = files.withColumn(name, value)
    files = files.withColumn("basename", basename(F.col("path"))).withColumn("file_id", F.sha2("content", 256))
    return files.select("file_id", "path", "basename", "content", "length", "modificationTime", "forced_type")


def from_documents(docs: DataFrame) -> DataFrame:
    return shaped(docs.select(F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content")))


def from_pages(pages: DataFrame) -> DataFrame:
    return shaped(pages.select(F.regexp_replace("url", r"[?#].*\z", "").alias("path"), F.encode("html", "UTF-8").alias("content")))
