"""The wide extraction of files: one pass over contents, then views as relations.

Families are separate expressions, so a view that is not asked for is not
computed; files are identified before anything else, and only types with a
reader are opened.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions.bytes import byte_facts, window_facts
from faktum.functions.text import SPANS, char_metrics, escape_metrics, invisible_spans, line_facts, line_metrics, longest_line_spans, metrics_of_bytes
from faktum.operators.identify import identify
from faktum.sources.containers import peek


def identified(files: DataFrame) -> DataFrame:
    return identify(files, peek(F.col("path"), F.col("content")))


def metrics(files: DataFrame) -> DataFrame:
    """(file_id, key, value, spans) of every file: bytes for all, text where the bytes are UTF-8; zero values are left out."""
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.select("file_id", "content", F.col("length").cast("double").alias("length"), utf8.alias("text"), window_facts(F.col("content")).alias("w"), byte_facts(F.col("content")).alias("b"))
    t = F.col("text")
    rows = rows.withColumn("l", line_facts(t))
    text = {f"text.{k}": v for k, v in ({k: F.col(f"l.{k}") for k in rows.schema["l"].dataType.names} | char_metrics(t) | escape_metrics(t) | metrics_of_bytes(F.col("b"), F.col("length"))).items()}
    own: dict[str, Column] = {
        "file.size_bytes": F.col("length"),
        "file.entropy": F.col("w.overall"),
        "binary.overall_entropy": F.col("w.overall"),
        "binary.peak_region_bytes": F.col("w.peak_bytes").cast("double"),
    } | {k: F.when(t != "", v) for k, v in text.items()}
    none = F.array().cast(SPANS)
    located = {"text.max_line_length": longest_line_spans(t), "text.invisible_chars": F.when(own["text.invisible_chars"] > 0, invisible_spans(t))}
    facts = [F.struct(F.lit(k).alias("key"), v.alias("value"), F.coalesce(located.get(k, none), none).alias("spans")) for k, v in own.items()]
    facts.append(F.struct(F.lit("binary.peak_region_entropy").alias("key"), F.col("w.peak").alias("value"), F.col("w.spans").cast(SPANS).alias("spans")))
    return rows.select("file_id", F.inline(F.array(*facts))).filter("value IS NOT NULL")


def wide(long: DataFrame, keys: list[str]) -> DataFrame:
    return long.groupBy("file_id").pivot("key", keys).agg(F.first("value"))


def highest(files: DataFrame, k: int) -> DataFrame:
    """The k files of the greatest entropy."""
    return files.select("file_id", "path", window_facts(F.col("content"))["overall"].alias("entropy")).orderBy(F.desc("entropy"), "path").limit(k)


def flagship(docs: DataFrame, labels: DataFrame, k: int = 20) -> DataFrame:
    """The k documents of the greatest byte entropy with their text metrics and labels."""
    from pyspark.sql import Window as W

    facts = window_facts(F.encode("text", "UTF-8"))
    rows = docs.filter("text <> ''").select("doc_id", "lang", "text", facts.alias("w")).orderBy(F.desc("w.overall"), "doc_id").limit(k)
    own = {x: v for x, v in line_metrics(F.col("text")).items() if x in ("total_lines", "avg_line_length", "max_line_length")}
    rows = rows.select("doc_id", "lang", F.round("w.overall", 6).alias("entropy"), F.round("w.peak", 6).alias("peak_region_entropy"), *(F.round(v, 6).alias(x) for x, v in own.items()))
    out = rows.join(labels.select("doc_id", "quality", "toxic"), "doc_id", "left")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("entropy"), "doc_id")))
