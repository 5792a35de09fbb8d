"""Structured records: manifests, registry timelines, JSON, Markdown, PKG-INFO, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

JSON_LIMIT = 76_800
TTL_SECONDS, MOST_ITEMS, MOST_BYTES, KEEP_SHARE = 30 * 86_400, 16_000, 2 << 30, 0.9


def generic_json(text: Column, limit: int = JSON_LIMIT) -> Column:
    """struct(parsed, skipped, limit_bytes): JSON is parsed up to the limit, beyond it only marked."""
    size = F.octet_length(text)
    return F.struct(F.when(size <= limit, F.try_parse_json(text)).alias("parsed"), (size > limit).alias("skipped"), F.when(size > limit, F.lit(limit)).alias("limit_bytes"))


def package_timeline(releases: DataFrame, now: int) -> DataFrame:
    """releases: (package, at unix seconds).  Counts in the last 24 and 48 hours, ages in days, span; times after `now` count as now."""
    age = F.greatest(F.lit(now) - F.col("at"), F.lit(0))
    return releases.groupBy("package").agg(
        F.count(F.lit(1)).alias("releases"),
        F.count_if(age <= 86_400).alias("releases_24h"),
        F.count_if(age <= 172_800).alias("releases_48h"),
        F.floor(F.greatest(F.lit(now) - F.min("at"), F.lit(0)) / 86_400).alias("package_age_days"),
        F.floor(F.greatest(F.lit(now) - F.max("at"), F.lit(0)) / 86_400).alias("age_days"),
    )


def previous_release(releases: DataFrame) -> DataFrame:
    """As-of: each release with the latest strictly earlier one of its package."""
    w = W.partitionBy("package").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    return releases.withColumn("previous_at", F.max("at").over(w))


def pkg_info(text: Column) -> Column:
    """Headers up to the first blank line: array of (lower-case key, value), continuation lines joined by LF."""
    head = F.substring_index(F.regexp_replace(text, "\r\n", "\n"), "\n\n", 1)
    logical = F.split(F.regexp_replace(head, r"\n[ \t]+", ""), "\n")
    rows = F.filter(logical, lambda x: x.rlike(r"\A[^:\s][^:]*:"))
    return F.transform(rows, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.replace(F.trim(F.regexp_replace(x, r"\A[^:]*:", "")), F.lit(""), F.lit("\n")).alias("value")))


def markdown(text: Column) -> Column:
    """struct(title, repos): the first ATX heading outside fences, and owner/repo of github links in the order seen."""
    open_ = F.regexp_replace(text, r"(?ms)^ {0,3}(```|~~~).*?(?:^ {0,3}\1[^\n]*$|\z)", "")
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_extract(open_, r"(?m)^ {0,3}#{1,6}[ \t]+([^\n]*)$", 1), r"[ \t]+#+[ \t]*\z", "")), F.lit(""))
    links = F.regexp_extract_all(text, F.lit(r"github\.com/([A-Za-z0-9_.\-]+/[A-Za-z0-9_.\-]*[A-Za-z0-9_\-])"), F.lit(1))
    return F.struct(title.alias("title"), F.array_distinct(F.transform(links, lambda x: F.regexp_replace(x, r"\.git\z", ""))).alias("repos"))


def expired(cache: DataFrame, now: int, ttl: int = TTL_SECONDS) -> DataFrame:
    return cache.filter(F.col("used_at") < now - ttl)


#: Seconds of the stretches of time that running sums are made of, the longest first; each is a whole number of the next.
STRETCHES = (86_400, 3_600, 60)


def retained(cache: DataFrame, now: int, ttl: int = TTL_SECONDS, items: int = MOST_ITEMS, size: int = MOST_BYTES, share: float = KEEP_SHARE) -> DataFrame:
    """What stays of cache (key, used_at, bytes): what is in time, newest first, down to `share` of a ceiling that is passed.

    Running sums are made of partial sums by day, hour and minute, each within the one before, so a window has no more
    than a minute's rows, or an hour's minutes, or a day's hours, or all days.
    """
    stretch = lambda k: F.floor(F.col("used_at") / STRETCHES[k]).alias(f"t{k}")
    last = len(STRETCHES) - 1
    live = cache.filter(F.col("used_at") >= now - ttl).select("key", "used_at", "bytes", stretch(last))
    sums = [live.groupBy(f"t{last}").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))]
    for k in range(last - 1, -1, -1):
        finer = sums[0].withColumn(f"t{k}", F.floor(F.col(f"t{k + 1}") * STRETCHES[k + 1] / STRETCHES[k]))
        sums[0] = finer
        sums.insert(0, finer.groupBy(f"t{k}").agg(F.sum("n").alias("n"), F.sum("b").alias("b")))
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = None
    for k, own in enumerate(sums):
        later = (W.partitionBy(f"t{k - 1}") if k else W).orderBy(F.desc(f"t{k}")).rowsBetween(W.unboundedPreceding, -1)
        own = own.withColumn("n0", F.coalesce(F.sum("n").over(later), F.lit(0))).withColumn("b0", F.coalesce(F.sum("b").over(later), F.lit(0)))
        if before is None:
            before = own.select("t0", "n0", "b0", F.sum("n").over(whole).alias("n_all"), F.sum("b").over(whole).alias("b_all"))
        else:
            upper = before.withColumnsRenamed({"n0": "n1", "b0": "b1"})
            before = own.join(upper, f"t{k - 1}").select(f"t{k}", (F.col("n0") + F.col("n1")).alias("n0"), (F.col("b0") + F.col("b1")).alias("b0"), "n_all", "b_all")
    own = W.partitionBy(f"t{last}").orderBy(F.desc("used_at"), "key").rowsBetween(W.unboundedPreceding, 0)
    rows = live.join(before, f"t{last}").withColumn("rank", F.col("n0") + F.count(F.lit(1)).over(own)).withColumn("total", F.col("b0") + F.sum("bytes").over(own))
    full = (F.col("n_all") > items) | (F.col("b_all") > size)
    return rows.filter(~full | ((F.col("rank") <= items * share) & (F.col("total") <= size * share))).select("key", "used_at", "bytes")
