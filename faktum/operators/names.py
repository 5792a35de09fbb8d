"""Metrics of identifiers, imports, literals and symbols by file: ordinary grouped aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions import strings as S
from faktum.functions.bytes import byte_entropy


def entropy(s: Column) -> Column:
    return byte_entropy(F.encode(s, "UTF-8"))


def identifier_metrics(names: DataFrame) -> DataFrame:
    """names: (file_id, name), a row for each occurrence, or (file_id, name, n) for n of them.  All but total are over a file's distinct names."""
    counted = names.filter("name <> ''").groupBy("file_id", "name").agg((F.sum("n") if "n" in names.columns else F.count(F.lit(1))).alias("n"))
    s, size = F.col("name"), F.octet_length("name")
    counted = counted.withColumn("entropy", entropy(s)).withColumn("size", size)
    count = lambda test: F.count_if(test).cast("double")
    ratio = lambda test: F.round(F.count_if(test) / F.count(F.lit(1)), 6)
    same = F.replace(s, F.substring(s, 1, 1), F.lit("")) == ""
    return counted.groupBy("file_id").agg(
        F.sum("n").cast("double").alias("total"),
        F.count(F.lit(1)).cast("double").alias("unique_count"),
        F.round(F.count(F.lit(1)) / F.sum("n"), 6).alias("reuse_ratio"),
        F.round(F.avg("size"), 6).alias("avg_length"),
        F.min("size").cast("double").alias("min_length"),
        F.max("size").cast("double").alias("max_length"),
        F.round(F.stddev_pop("size"), 6).alias("length_stddev"),
        count(size == 1).alias("single_char_count"),
        ratio(size == 1).alias("single_char_ratio"),
        ratio(s.rlike(r"\A[a-z_]*\z")).alias("all_lowercase_ratio"),
        ratio(s.rlike(r"\A[A-Z_]*\z")).alias("all_uppercase_ratio"),
        ratio(s.rlike("[0-9]")).alias("has_digit_ratio"),
        count(s.startswith("_")).alias("underscore_prefix_count"),
        count(s.rlike(r"(?s)\A__.+__\z")).alias("double_underscore_count"),
        count(s.rlike(r"(?s)[A-Za-z].*[0-9]\z")).alias("numeric_suffix_count"),
        count(S.is_hex_like(s)).alias("hex_like_names"),
        count(S.is_base64_like(s)).alias("base64_like_names"),
        count(S.is_sequential(s)).alias("sequential_names"),
        count(S.has_keyboard_walk(s)).alias("keyboard_pattern_names"),
        count((size >= 3) & same).alias("repeated_char_names"),
        F.round(F.avg("entropy"), 6).alias("avg_entropy"),
        count(F.round("entropy", 9) > 3.5).alias("high_entropy_count"),
        ratio(F.round("entropy", 9) > 3.5).alias("high_entropy_ratio"),
    )


def literal_metrics(strings: DataFrame) -> DataFrame:
    """strings: (file_id, value), a row for each literal."""
    s, size = F.col("value"), F.octet_length("value")
    own = strings.withColumn("size", size).withColumn("entropy", F.when(size > 0, F.round(entropy(s), 9)))
    count = F.count_if
    return own.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("size").alias("total_bytes"),
        F.round(F.avg("size"), 6).alias("avg_length"),
        F.max("size").alias("max_length"),
        count(F.col("size") == 0).alias("empty_count"),
        F.round(F.avg("entropy"), 6).alias("avg_entropy"),
        F.round(F.stddev_pop("entropy"), 6).alias("entropy_stddev"),
        count(F.col("entropy") > 5.0).alias("high_entropy_count"),
        count(F.col("entropy") > 6.5).alias("very_high_entropy_count"),
        count(F.col("size") > 1000).alias("very_long_strings"),
        count(S.is_likely_base64(s)).alias("base64_candidates"),
        count(S.is_hex_string(s)).alias("hex_strings"),
        count(S.has_url_encoding(s)).alias("url_encoded_strings"),
        count(S.has_unicode_heavy(s)).alias("unicode_heavy_strings"),
        count(S.is_url(s)).alias("url_count"),
        count(S.is_file_path(s)).alias("path_count"),
        count(S.is_ip_address(s)).alias("ip_count"),
        count(S.is_email(s)).alias("email_count"),
        count(S.is_domain(s)).alias("domain_count"),
        count(S.has_embedded_code(s)).alias("embedded_code_candidates"),
        count(S.has_shell_command(s)).alias("shell_command_strings"),
        count(S.has_sql_pattern(s)).alias("sql_strings"),
    )
