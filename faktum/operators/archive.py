"""Aggregates over archive members: one grouped aggregation a file, whatever the archive's format.

members: (file_id, ord, path, size_bytes, compressed_bytes, entry_type, method,
mode, mtime_unix, crc32, encrypted, extra_bytes, comment_bytes).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Extensions and names that the classifier knows.
EXECUTABLE = "exe dll sys scr com cpl msi so dylib bin elf out app".split()
SCRIPT = "sh bash zsh ksh csh fish py pyc pyo pl pm rb js mjs cjs ps1 psm1 psd1 bat cmd vbs vbe wsf wsh lua php".split()
ARCHIVE = "zip jar war ear apk ipa xpi crx nupkg tar gz tgz bz2 tbz2 xz txz zst tzst 7z rar cab iso deb rpm msi pkg".split()
HARMLESS = "txt pdf doc docx jpg jpeg png gif mp3 mp4 csv xls xlsx rtf".split()
HOMOGLYPHS = "асеорхуАВСЕНКМОРТХ" + "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον"
IN_BIN = ["bin/", "usr/bin/", "sbin/", "usr/sbin/", "usr/local/bin/"]
IN_LIB = ["lib/", "lib64/", "usr/lib/", "usr/lib64/", "usr/local/lib/"]
FAR_FUTURE = 4_102_444_800
OUTLIERS = 16


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def name_tests(path: Column) -> dict[str, Column]:
    """What a member's name says, as booleans."""
    base = F.substring_index(path, "/", -1)
    lower = F.translate(base, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    ext = F.when(lower.contains("."), F.substring_index(lower, ".", -1)).otherwise("")
    inner = F.regexp_extract(lower, r"(?s)\.([^.]*)\.[^.]*\z", 1)
    under = lambda xs: _any([path.startswith(x) for x in xs])
    misplaced = F.when(ext.isin("so", "dylib") & ~under(IN_LIB), True).when(ext.isin("exe", "dll", "sys", "scr"), ~F.lower(path).contains("bin/")).when(ext.isin("bin", "elf"), ~under(IN_BIN)).otherwise(False)
    return {
        "hidden": path.rlike(r"(?:\A|/)\.(?!/|\z|\./|\.\z)"),
        "traversal": path.rlike(r"(?:\A|/)\.\.(?:/|\z)") | path.startswith("/") | path.rlike(r"\A[A-Za-z]:\\"),
        "unicode": path.rlike(r"[^\x00-\x7f]"),
        "homoglyph": path.rlike(f"[{HOMOGLYPHS}]"),
        "rtlo": path.rlike("[‪-‮⁦-⁩]"),
        "double_extension": ext.isin(EXECUTABLE) & inner.isin(HARMLESS),
        "executable": ext.isin(EXECUTABLE),
        "script": ext.isin(SCRIPT),
        "nested_archive": ext.isin(ARCHIVE),
        "misplaced": misplaced,
        "noise": path.startswith("__MACOSX/") | base.isin(".DS_Store", "Thumbs.db", "desktop.ini"),
    }


def member_metrics(members: DataFrame) -> DataFrame:
    """One wide row of counts and sizes for each file.

    Sums are one grouping, for which a task makes one row a file before rows meet; distinct counts are another over their
    columns alone, since a grouping with both carries all sums along with each value.  The two meet by file as they are
    dealt out; members without a file have the one null group, in which no join is needed.
    """
    some, none = members.filter("file_id IS NOT NULL"), members.filter("file_id IS NULL")
    lone = _sums(none).crossJoin(none.agg(*_distinct())).filter("member_count > 0") if members.schema["file_id"].nullable else None
    counted = _sums(some).join(some.groupBy("file_id").agg(*_distinct()), "file_id")
    own = counted if lone is None else counted.unionByName(lone)
    own = own.withColumns({"duplicate_member_count": F.col("_paths") - F.col("_own_paths"), "crc_collision_count": F.col("_crcs") - F.col("_own_crcs"), "mtime_unique_count": F.col("_own_mtimes")})
    own = own.withColumn("mtime_unique_ratio", F.round(F.try_divide("_own_mtimes", "_mtimes"), 6))
    return own.select(*(c for c in own.columns if not c.startswith("_")))


def _crc() -> Column:
    return F.when(F.col("size_bytes") > 0, F.col("crc32"))


def _distinct() -> list[Column]:
    return [F.countDistinct("path").alias("_own_paths"), F.countDistinct(_crc()).alias("_own_crcs"), F.countDistinct("mtime_unix").alias("_own_mtimes")]


def _sums(members: DataFrame) -> DataFrame:
    m = members
    for k, test in name_tests(F.col("path")).items():
        m = m.withColumn(f"is_{k}", test)
    file = F.col("entry_type") != "directory"
    runs = F.col("is_executable") | F.coalesce(F.col("mode").bitwiseAND(0o111) != 0, F.lit(False))
    count = lambda test: F.count_if(test)
    bit = lambda b: count(F.col("mode").bitwiseAND(b) != 0)
    return m.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("member_count"),
        count(file).alias("file_count"),
        count(~file).alias("directory_count"),
        F.sum("size_bytes").alias("total_uncompressed"),
        F.sum("compressed_bytes").alias("total_compressed"),
        F.round(F.try_divide(F.sum("compressed_bytes"), F.sum("size_bytes")), 6).alias("compression_ratio"),
        bit(0o4000).alias("setuid_count"),
        bit(0o2000).alias("setgid_count"),
        bit(0o1000).alias("sticky_count"),
        bit(0o2).alias("world_writable_count"),
        count(F.col("entry_type") == "symlink").alias("symlink_count"),
        count(F.col("encrypted")).alias("encrypted_count"),
        F.max(F.octet_length("path")).alias("max_filename_length"),
        *(count(F.col(f"is_{k}")).alias(f"{k}_count") for k in ("hidden", "traversal", "script", "unicode", "homoglyph", "double_extension", "rtlo", "nested_archive", "misplaced", "noise")),
        count(file & runs).alias("executable_count"),
        F.round(F.max(F.when(file & (F.col("compressed_bytes") > 0), F.col("size_bytes") / F.col("compressed_bytes"))), 6).alias("zip_bomb_ratio"),
        F.sum("extra_bytes").alias("extra_field_size"),
        count(F.col("comment_bytes") > 0).alias("entry_comment_count"),
        F.sum("comment_bytes").alias("entry_comment_size"),
        F.count("path").alias("_paths"),
        F.count(_crc()).alias("_crcs"),
        count(F.col("mtime_unix").isNull()).alias("sentinel_mtime_count"),
        (F.max("mtime_unix") - F.min("mtime_unix")).alias("mtime_spread_seconds"),
        F.count("mtime_unix").alias("_mtimes"),
        count(F.col("mtime_unix") > FAR_FUTURE).alias("future_mtime_count"),
    )


def symlink_escapes(members: DataFrame) -> DataFrame:
    """members with linkname, of archives that keep it (tar): links to absolute targets or through `..`, for each file."""
    target = F.col("linkname")
    out = (F.col("entry_type") == "symlink") & (target.startswith("/") | F.array_contains(F.split(target, "/"), ".."))
    return members.groupBy("file_id").agg(F.count_if(out).alias("symlink_escape_count"))


def histogram(members: DataFrame, column: str) -> DataFrame:
    """Members by entry type or compression method."""
    return members.groupBy("file_id", F.replace(F.col(column), F.lit("-"), F.lit("_")).alias(column)).agg(F.count(F.lit(1)).alias("n"))


def dominant(rows: DataFrame, key: str, bucket: str) -> DataFrame:
    """The commonest bucket of each key (null is a bucket; the latest of equals), its share, and how many lie outside a strict majority."""
    counts = rows.groupBy(key, bucket).agg(F.count(F.lit(1)).alias("n"))
    out = counts.groupBy(key).agg(F.sum("n").alias("members"), F.max(F.struct("n", bucket)).alias("top"))
    share = F.col("top.n") / F.col("members")
    return out.select(key, F.col(f"top.{bucket}").alias("dominant"), F.col("top.n").alias("dominant_count"), F.round(share, 6).alias("dominant_fraction"), F.when((share > 0.5) & (share < 1), F.col("members") - F.col("top.n")).alias("outlier_count"))


def outliers(rows: DataFrame, key: str, bucket: str, order: str, most: int = OUTLIERS) -> DataFrame:
    """The first `most` rows outside the dominant bucket of keys that have a strict majority."""
    tops = dominant(rows, key, bucket).filter("outlier_count IS NOT NULL")
    odd = rows.join(tops.select(key, F.col("dominant")), key).filter(~F.col(bucket).eqNullSafe(F.col("dominant"))).drop("dominant")
    return odd.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(order))).filter(F.col("rank") <= most)
