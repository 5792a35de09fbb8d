"""Exact deduplication with DataFrame operations only.

Texts are equal when they are identical after each run of white space
`[\\x20\\x09-\\x0D]+` became one space; null counts as empty.  Rows are grouped
by a 128-bit content hash with partial sums before the shuffle, so a group that
holds a third of all rows costs one row a task.  Bytes are compared inside
each group by its smallest and largest text: where these are the same, so are
all between.  Groups where they differ (a collision of the hash) are grouped
again by the text itself.

The row with the smallest doc_id of a group stays; a null doc_id stays only in
a group that has no other.  Rows that repeat both doc_id and text are the same
document to `mark` (each has the same answer); `drop` leaves one of them.
Columns other than doc_id and text are never read by `mark`, and go through
`drop` as they are, whatever their names.  An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.llm.storage import cut, table

SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def content_hash(norm: Column) -> Column:
    """128 bits."""
    return F.unhex(F.md5(norm))


def _marked(docs: DataFrame, keep: list[str], hashed: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(each row's `keep` columns with keep_id, group_size and text_sha256; the groups)."""
    norm = normalised(F.col("text"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row"), F.col("doc_id").cast("long").alias("id"), norm.alias("norm"))
    rows = rows.withColumn("hash", hashed(F.col("norm")))
    groups = rows.groupBy("hash").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min("norm").alias("low"), F.max("norm").alias("high"))
    groups = cut(groups.select("hash", "keep_id", "group_size", F.sha2("low", 256).alias("text_sha256"), (F.col("low") == F.col("high")).alias("same")))
    mixed = groups.filter(~F.col("same")).select("hash")
    out = rows.drop("norm").join(groups.filter("same").drop("same"), "hash").drop("hash")
    if mixed.limit(1).count():
        members = rows.join(mixed, "hash")
        exact = members.groupBy("hash", "norm").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        exact = exact.withColumn("text_sha256", F.sha2("norm", 256))
        out = out.unionByName(members.join(exact, ["hash", "norm"]).drop("hash", "norm"))
        groups = groups.filter("same").select("keep_id").unionByName(exact.select("keep_id"))
    return out, groups


def mark(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs."""
    out, _ = _marked(docs.select("doc_id", "text"), ["doc_id"], hashed)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop(docs: DataFrame, hashed: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows of docs that stay, with all their columns; one for each distinct text."""
    out, groups = _marked(docs, docs.columns, hashed)
    out = out.filter(F.col("id").eqNullSafe(F.col("keep_id")))
    if out.select("id").count() > groups.count():
        out = out.groupBy("id", "text_sha256").agg(F.min_by("row", F.xxhash64("row")).alias("row"))  # the same one if a task runs again
    return out.select("row.*")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark(table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
