"""Names, people and versions as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of archives, and first labels of reverse host names.
ARCHIVE_ENDINGS = ".tar.gz .tgz .tar.bz2 .tbz2 .tbz .tar.xz .txz .tar.zst .tzst .tar.z .tar.lz .tar .zip .7z .rar .gem .whl .crate .jar .deb .rpm .gz".split()
REVERSE_TLDS = "com org net io co dev app me gnu".split()


def _ending() -> str:
    return "(?i:" + "|".join(x.replace(".", r"\.") for x in ARCHIVE_ENDINGS) + ")"


def name_version(base: Column) -> Column:
    """struct(name, version) of an archive's file name, or null."""
    stem = F.regexp_replace(F.regexp_replace(base, rf"(?s){_ending()}\z", ""), r"\A[12][0-9]{3}-[01][0-9]-[0-3][0-9]-", "")
    pattern = r"(?s)\A(.+?)[-_.](v?[0-9][0-9A-Za-z._+~\-]*)\z"
    fits = base.rlike(rf"{_ending()}\z") & stem.rlike(pattern)
    return F.when(fits, F.struct(F.regexp_extract(stem, pattern, 1).alias("name"), F.regexp_extract(stem, pattern, 2).alias("version")))


def _between(s: Column, a: str, b: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(s, rf"(?s)\{a}([^\{b}]*)\{b}", 1)), F.lit(""))


def person(s: Column) -> Column:
    """struct(name, email, url) of `Name <email> (url)`."""
    name = F.when(s.contains("<"), F.substring_index(s, "<", 1)).otherwise(F.substring_index(s, "(", 1))
    return F.struct(F.nullif(F.trim(name), F.lit("")).alias("name"), _between(s, "<", ">").alias("email"), _between(s, "(", ")").alias("url"))


def dn_attribute(dn: Column, attribute: str) -> Column:
    """A part of a distinguished name; commas and plus signs that are escaped don't end one."""
    marked = F.regexp_replace(F.regexp_replace(dn, r"\\,", ""), r"\\\+", "")
    parts = F.filter(F.transform(F.split(marked, "[,+]"), lambda x: F.trim(x)), lambda x: F.lower(F.trim(F.substring_index(x, "=", 1))).eqNullSafe(F.lit(attribute.lower())) & x.rlike(r"=\s*[^\s]"))
    value = F.trim(F.regexp_replace(F.try_element_at(parts, F.lit(1)), r"\A[^=]*=", ""))
    return F.nullif(F.regexp_replace(F.translate(value, "", ",+"), r"\\(.)", "$1"), F.lit(""))


def vendor(reverse_host: Column) -> Column:
    """`com.example.tool` to `Example`."""
    label = F.split_part(reverse_host, F.lit("."), F.lit(2))
    return F.when(F.split_part(reverse_host, F.lit("."), F.lit(1)).isin(REVERSE_TLDS) & (label != ""), F.concat(F.upper(F.substring(label, 1, 1)), F.substring(label, 2, 1 << 30)))


def forge_purl(url: Column) -> Column:
    """A source forge's address as a package url."""
    pattern = r"(?i)\A(?:git\+)?(?:https?|git|ssh)://(?:[^/@]*@)?(github|gitlab|bitbucket)\.(?:com|org)[/:]([^/\s]+)/([^/\s#?]+)"
    repo = F.regexp_replace(F.regexp_extract(url, pattern, 3), r"(?i)\.git\z", "")
    return F.when(url.rlike(pattern), F.concat(F.lit("pkg:"), F.lower(F.regexp_extract(url, pattern, 1)), F.lit("/"), F.lower(F.regexp_extract(url, pattern, 2)), F.lit("/"), F.lower(repo)))


def similarity_hash(names: Column) -> Column:
    """MD5 of the lower-case names, sorted, distinct and joined by commas."""
    return F.md5(F.array_join(F.sort_array(F.array_distinct(F.transform(names, F.lower))), ","))


def import_hash(pairs: Column) -> Column:
    """MD5 of `library.name` in import order, without .dll, .ocx and .sys."""
    return F.md5(F.array_join(F.transform(pairs, lambda p: F.concat(F.regexp_replace(F.lower(p["library"]), r"\.(?:dll|ocx|sys)\z", ""), F.lit("."), F.lower(p["name"]))), ","))


def dos_time(date: Column, time: Column) -> Column:
    """Unix seconds of an MS-DOS date and time, null for the zero date."""
    day = F.make_date((F.shiftright(date, 9) + 1980).cast("int"), F.shiftright(date, 5).bitwiseAND(F.lit(15)).cast("int"), date.bitwiseAND(F.lit(31)).cast("int"))
    seconds = F.shiftright(time, 11) * 3600 + F.shiftright(time, 5).bitwiseAND(F.lit(63)) * 60 + time.bitwiseAND(F.lit(31)) * 2
    return F.when(date > 0, F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400 + seconds)


def filetime(ticks: Column) -> Column:
    """Unix seconds of a count of 100 ns since 1601."""
    return F.floor(ticks / 10_000_000) - 11_644_473_600


def purl_python(name: Column, version: Column) -> Column:
    normal = F.regexp_replace(F.lower(name), "[-_.]+", "-")
    return F.concat(F.lit("pkg:pypi/"), normal, F.coalesce(F.concat(F.lit("@"), version), F.lit("")))
