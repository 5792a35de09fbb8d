"""Records of package registries: one JSON document a file, as values and metrics under `registry.`."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of fields, by what they become: text values, numbers as metrics, flags as metrics of 0 or 1.
TEXTS = "ecosystem name version latest_version author title description homepage repository repository_commit license deprecated publisher publisher_email_domain".split()
NUMBERS = "published_at age_days downloads_total downloads_recent rating rating_count maintainers first_published_at previous_published_at package_age_days release_count releases_24h releases_48h unpacked_size file_count vulnerability_count".split()
FLAGS = "has_install_script publisher_in_maintainers publisher_verified security_hold version_removed".split()
#: A document without these is no record.
REQUIRED = ("ecosystem", "name", "version")

_SCHEMA = ", ".join([*(f"{x} string" for x in TEXTS), *(f"{x} double" for x in NUMBERS), *(f"{x} boolean" for x in FLAGS)])


def parsed(json: Column) -> Column:
    """The record as a struct of its fields; null for what is no JSON object with the required fields."""
    own = F.from_json(json, _SCHEMA, {"mode": "PERMISSIVE"})
    return F.when(F.coalesce(reduce(lambda a, b: a & b, (own[x].isNotNull() for x in REQUIRED)), F.lit(False)), own)


def facts(records: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, key, text, number): what a record says, empty texts and missing fields left out.

    Two metrics are derived: whether the version is deprecated, and for how many whole days the package lay still before
    it (none if it came before the one before it).
    """
    own = records.select(*keys, parsed(F.col(json)).alias("r")).filter("r IS NOT NULL")
    r = lambda x: F.col(f"r.{x}").cast("float").cast("double") if x == "rating" else F.col(f"r.{x}")  # noqa: E731  # ratings have single precision
    none, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    still = F.floor(F.greatest(r("published_at") - r("previous_published_at"), F.lit(0.0)) / 86_400).cast("double")
    rows = [
        *(F.struct(F.lit(f"registry.{x}").alias("key"), r(x).alias("text"), number.alias("number")) for x in TEXTS),
        *(F.struct(F.lit(f"registry.{x}").alias("key"), none.alias("text"), r(x).alias("number")) for x in NUMBERS),
        *(F.struct(F.lit(f"registry.{x}").alias("key"), none.alias("text"), r(x).cast("double").alias("number")) for x in FLAGS),
        F.struct(F.lit("registry.is_deprecated").alias("key"), none.alias("text"), r("deprecated").isNotNull().cast("double").alias("number")),
        F.struct(F.lit("registry.days_since_previous_release").alias("key"), none.alias("text"), F.when(r("published_at").isNotNull() & r("previous_published_at").isNotNull(), still).alias("number")),
    ]
    return own.select(*keys, F.inline(F.array(*rows))).filter("text <> '' OR number IS NOT NULL")
