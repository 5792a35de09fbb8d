"""Aggregates and anomalies over sections and segments of binaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.functions.bytes import byte_facts

#: Section names that compilers and linkers make, without leading dots.
STANDARD = (
    "text data bss rdata rodata idata edata pdata xdata reloc rsrc tls init fini plt got got.plt dynsym dynstr dynamic symtab strtab shstrtab interp comment eh_frame eh_frame_hdr init_array fini_array ctors dtors "
    "hash gnu.hash gnu.version gnu.version_r note rela.dyn rela.plt cstring const stubs stub_helper la_symbol_ptr nl_symbol_ptr unwind_info objc_classlist debug"
).split()


def executable(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(F.lit("executable"), F.lit("execinstr")))


def writable(flags: Column) -> Column:
    return F.arrays_overlap(flags, F.array(F.lit("writable"), F.lit("write")))


def section_metrics(sections: DataFrame, files: DataFrame) -> DataFrame:
    """sections: (file_id, ord, name, file_offset, file_size, flags, entropy); files: (file_id, length)."""
    x, w = F.coalesce(executable(F.col("flags")), F.lit(False)), F.coalesce(writable(F.col("flags")), F.lit(False))
    s = sections.withColumn("x", x).withColumn("w", w)
    bare = F.regexp_replace(F.regexp_replace("name", r"\A.*,", ""), r"\A[._]+", "")
    known = F.col("entropy").isNotNull()
    weighted = lambda test: F.round(F.try_divide(F.sum(F.when(test & known, F.col("entropy") * F.col("file_size"))), F.sum(F.when(test & known, F.col("file_size")))), 6)
    code = F.sum(F.when(F.col("x"), F.col("file_size")).otherwise(0))
    data = F.sum(F.when(F.col("w") & ~F.col("x"), F.col("file_size")).otherwise(0))
    agg = s.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.max("entropy"), 6).alias("entropy_max"),
        F.max_by(F.when(known, F.col("name")), F.struct("entropy", -F.col("ord"))).alias("entropy_max_section"),
        F.round(F.avg("entropy"), 6).alias("entropy_mean"),
        F.count_if("x").alias("executable_count"),
        F.count_if("w").alias("writable_count"),
        F.count_if(F.col("x") & F.col("w")).alias("executable_writable_count"),
        F.when(code > 0, code).alias("code_size"),
        F.count_if(~bare.isin(STANDARD)).alias("nonstandard_count"),
        F.array_join(F.collect_list("name"), "").alias("_names"),
        F.when(F.count("entropy") >= 2, F.round(F.var_pop("entropy"), 6)).alias("entropy_variance"),
        weighted(F.col("x")).alias("code_entropy"),
        weighted(F.col("w") & ~F.col("x")).alias("data_entropy"),
        F.round(F.try_divide(code, code + data), 6).alias("code_to_data_ratio"),
        F.max("file_size").alias("_largest"),
        F.max(F.col("file_offset") + F.col("file_size")).alias("_end"),
    )
    over = F.col("length") - F.col("_end")
    return agg.join(files.select("file_id", "length"), "file_id").select(
        *(c for c in agg.columns if not c.startswith("_")),
        F.when(F.col("_names") != "", F.round(byte_facts(F.encode("_names", "UTF-8"))["entropy"], 6)).alias("name_entropy"),
        F.round(F.try_divide("_largest", "length"), 6).alias("largest_section_ratio"),
        F.when(over > 0, 1.0).alias("has_overlay"),
        F.when(over > 0, over).alias("overlay_size"),
        F.when(over > 0, F.round(over / F.col("length"), 6)).alias("overlay_ratio"),
    )


def adjacent_overlaps(spans: DataFrame, key: str, start: str, end: str, label: str) -> DataFrame:
    """How many distinct labels take part in an overlap of neighbours by start."""
    w = W.partitionBy(key).orderBy(start, end, label)
    hit = (F.lead(start).over(w) < F.col(end)) | (F.lag(end).over(w) > F.col(start))
    return spans.withColumn("hit", hit).groupBy(key).agg(F.countDistinct(F.when(F.col("hit"), F.col(label))).alias("overlap_count"))


def unclaimed(extents: DataFrame, key: str, start: str, end: str, whole: DataFrame, size: str, least: int = 1) -> DataFrame:
    """Gaps of at least `least` that no extent covers, the tail up to `size` of `whole` included."""
    rows = extents.select(key, F.col(start).alias("s"), F.col(end).alias("e")).unionByName(whole.select(key, F.col(size).alias("s"), F.col(size).alias("e")))
    before = F.coalesce(F.max("e").over(W.partitionBy(key).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    gaps = rows.withColumn("gap_start", before).withColumn("gap_bytes", F.col("s") - before)
    return gaps.filter(F.col("gap_bytes") >= least).select(key, "gap_start", "gap_bytes")


def runs(rows: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Gaps and islands: maximal runs of consecutive `order` values where `value` holds: (key, first, last, length)."""
    own = rows.filter(value)
    island = F.col(order) - F.row_number().over(W.partitionBy(key).orderBy(order))
    return own.withColumn("island", island).groupBy(key, "island").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("length")).drop("island")


def inflated(sections: DataFrame) -> DataFrame:
    """Sections that take more than four times their bytes of the file in memory; sections: (file_id, ord, name, file_size, virtual_size)."""
    return sections.filter((F.col("file_size") != 0) & (F.col("virtual_size") > 4 * F.col("file_size")))


def table_anomalies(sections: DataFrame) -> DataFrame:
    """Of each file: names that several sections have, whether code or constants can be written to, debug and compressed sections, and whether both kinds of hash table are there; sections: (file_id, name, flags)."""
    packed = F.count_if(F.coalesce(F.array_contains("flags", "compressed"), F.lit(False)))
    by = sections.withColumn("w", F.coalesce(writable(F.col("flags")), F.lit(False))).groupBy("file_id", "name").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w"), packed.alias("c"))
    is_ = lambda name: F.max((F.col("name") == name) & F.col("w"))
    return by.groupBy("file_id").agg(F.count_if(F.col("n") > 1).alias("duplicate_section_name_count"), is_(".text").alias("text_section_writable"), is_(".rodata").alias("rodata_writable"), F.count_if(F.col("name").startswith(".debug")).alias("debug_name_count"), F.sum("c").alias("compressed_sections_count"), (F.max(F.col("name") == ".hash") & F.max(F.col("name") == ".gnu.hash")).alias("has_both_hash_tables"))
