"""Metrics of imports and functions by file: grouped aggregations over symbol rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.operators.names import entropy


def import_metrics(imports: DataFrame, stdlib: list[str]) -> DataFrame:
    """imports: (file_id, name, alias)."""
    name = F.col("name")
    known = F.split_part(name, F.lit("."), F.lit(1)).isin(stdlib)
    relative = name.startswith(".")
    ratio = lambda test: F.round(F.count_if(test) / F.count(F.lit(1)), 6)
    return imports.groupBy("file_id").agg(
        F.countDistinct("name").alias("unique_modules"),
        F.count_if(known).alias("stdlib_count"),
        F.count_if(~known & ~relative).alias("third_party_count"),
        F.count_if(relative).alias("relative_imports"),
        F.count_if(name.rlike("__import__|importlib|require")).alias("dynamic_imports"),
        F.count_if(name.contains("*")).alias("wildcard_imports"),
        F.count_if(F.col("alias").isNotNull()).alias("aliased_imports"),
        ratio(known).alias("stdlib_ratio"),
        ratio(~known & ~relative).alias("third_party_ratio"),
        ratio(relative).alias("relative_ratio"),
    )


def function_metrics(functions: DataFrame, sources: DataFrame) -> DataFrame:
    """functions: (file_id, ord, name, line, end_line, depth, params); sources: (file_id, text)."""
    from faktum.functions.text import lines

    inside = F.lead("depth").over(W.partitionBy("file_id").orderBy("ord")) > F.col("depth")  # symbols come in the order of their text
    functions = functions.withColumn("holds", F.coalesce(inside, F.lit(False)))
    f = functions.withColumn("size", F.col("end_line") - F.col("line") + 1).withColumn("n", F.size("params")).withColumn("e", entropy(F.coalesce("name", F.lit(""))))
    count = lambda test: F.count_if(test)
    sizes = F.transform("params", F.octet_length)
    f = f.withColumn("letters", F.aggregate(sizes, F.lit(0), lambda a, x: a + x)).withColumn("singles", F.size(F.filter(sizes, lambda x: x == 1)))
    out = f.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("count"),
        count(F.col("name").isNull()).alias("anonymous"),
        count(F.col("holds")).alias("nested_functions"),
        count(F.col("size") > 100).alias("over_100_lines"),
        count(F.col("size") > 500).alias("over_500_lines"),
        count(F.col("size") <= 1).alias("one_liners"),
        count(F.col("n") == 0).alias("no_params_count"),
        count(F.col("n") > 7).alias("many_params_count"),
        count(F.octet_length("name") == 1).alias("single_char_names"),
        count(F.col("e") > 3.5).alias("high_entropy_names"),
        count(F.col("name").rlike(r"[A-Za-z][0-9]\z")).alias("numeric_suffix_names"),
        F.round(F.avg("size"), 6).alias("avg_length_lines"),
        F.max("size").alias("max_length_lines"),
        F.min("size").alias("min_length_lines"),
        F.round(F.stddev_pop("size"), 6).alias("length_stddev"),
        F.round(F.avg("n"), 6).alias("avg_params"),
        F.max("n").alias("max_params"),
        F.round(F.try_divide(F.sum("letters"), F.sum("n")), 6).alias("avg_param_name_length"),
        F.sum("singles").alias("single_char_params"),
        F.round(F.avg(F.octet_length("name")), 6).alias("avg_name_length"),
        F.max("depth").alias("max_nesting_depth"),
        F.round(F.avg("depth"), 6).alias("avg_nesting_depth"),
        F.sum("size").alias("_all"),
    )
    whole = sources.select("file_id", F.size(lines(F.col("text"))).alias("_lines"))
    out = out.join(whole, "file_id")
    return out.withColumn("density_per_100_lines", F.round(100 * F.col("count") / F.col("_lines"), 6)).withColumn("code_in_functions_ratio", F.round(F.col("_all") / F.col("_lines"), 6)).drop("_all", "_lines")
