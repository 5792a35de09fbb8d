"""Where packages and binaries come from: build paths, parties, recipe records, add-on signatures, and what follows the last section."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions.bytes import byte_facts
from faktum.functions.text import trimmed

#: Sources of a build path, most trusted first; a scan of strings only stands in for the others.
BUILD_SOURCES = ["pe.debug.pdb.path", "elf.dwarf.comp_dirs", "strings"]
#: Fields of a recipe that are lists, and those that are single.
LISTS = "source depends makedepends checkdepends optdepends provides conflicts replaces arch license validpgpkeys noextract md5sums sha1sums sha224sums sha256sums sha384sums sha512sums b2sums".split()
SINGLE = "pkgbase pkgname pkgver pkgrel epoch url pkgdesc".split()


def build_path(found: DataFrame) -> DataFrame:
    """found: (file_id, ord, path, source) to one (file_id, build_path, source) a file: one that shows a home goes first."""
    home = F.lower("path").rlike(r"/users/|/home/|\\users\\")
    rank = F.array_position(F.array(*map(F.lit, BUILD_SOURCES)), F.col("source"))
    order = F.struct((F.col("source") == "strings").alias("scanned"), (~home).alias("plain"), rank.alias("rank"), "ord")
    best = found.filter("path IS NOT NULL").groupBy("file_id").agg(F.min_by(F.struct("path", "source"), order).alias("b"))
    return best.select("file_id", F.col("b.path").alias("build_path"), F.col("b.source").alias("source"))


def parties(authors: DataFrame) -> DataFrame:
    """authors: (file_id, ord, name, email, role) without those that have neither name nor email; of equal ones the first stays."""
    named = authors.filter("name IS NOT NULL OR email IS NOT NULL")
    first = named.groupBy("file_id", "name", "email").agg(F.min("ord").alias("ord"), F.min_by("role", "ord").alias("role"))
    return first.select("file_id", "ord", "name", "email", "role")


def emails(own: DataFrame) -> DataFrame:
    """(file_id, emails): each address once, in the order of its first party."""
    once = own.filter("email IS NOT NULL").groupBy("file_id", "email").agg(F.min("ord").alias("ord"))
    return once.groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "email"))), lambda x: x["email"]).alias("emails"))


def recipe_fields(recipes: DataFrame) -> DataFrame:
    """recipes: (file_id, text) of `key = value` lines to (file_id, key, items, is_list), with items in the order of their lines."""
    line = trimmed(F.col("line"))
    rows = recipes.select("file_id", F.posexplode(F.split("text", r"\r?\n")).alias("ord", "line")).filter(~line.startswith("#") & line.contains("="))
    rows = rows.select("file_id", "ord", trimmed(F.substring_index("line", "=", 1)).alias("key"), trimmed(F.expr("substring(line, instr(line, '=') + 1)")).alias("value"))
    base = F.substring_index("key", "_", 1)
    rows = rows.filter((F.col("value") != "") & (base.isin(LISTS + SINGLE) | F.col("key").isin(SINGLE)))
    items = F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"])
    return rows.groupBy("file_id", "key").agg(items.alias("items")).withColumn("is_list", base.isin(LISTS) | (F.size("items") > 1))


def github_owner(url: Column) -> Column:
    owner = F.lower(F.regexp_extract(url, r"(?s)\A.*?github\.com/([^/#?]*)", 1))
    return F.when((owner != "") & ~owner.contains("$"), owner)


def recipe_summary(fields: DataFrame) -> DataFrame:
    """(file_id, checksums, url_owner, source_owners) of recipe_fields: what two recipes are compared by."""
    base = F.substring_index("key", "_", 1)
    item = fields.select("file_id", "key", base.alias("base"), (F.size("items") == 1).alias("single"), F.explode("items").alias("item"))
    bare = trimmed(F.col("item"))
    owner = github_owner(F.element_at(F.split("item", "::"), -1))
    sums = F.collect_set(F.when(F.col("base").endswith("sums") & (F.upper(bare) != "SKIP") & (bare != ""), bare))
    owners = F.collect_set(F.when(F.col("base") == "source", owner))
    out = item.groupBy("file_id").agg(
        F.nullif(F.array_join(F.array_sort(sums), ","), F.lit("")).alias("checksums"),
        F.max(F.when((F.col("key") == "url") & F.col("single"), github_owner(F.col("item")))).alias("url_owner"),
        F.array_sort(owners).alias("source_owners"),
    )
    return out.withColumn("owners_differ", F.exists("source_owners", lambda x: x != F.col("url_owner")))


def addon_shape(members: DataFrame) -> DataFrame:
    """members: (file_id, path) of browser add-ons to how they are signed and built."""
    has = lambda x: F.coalesce(F.bool_or(F.col("path") == x), F.lit(False))
    out = members.groupBy("file_id").agg(
        (has("META-INF/mozilla.sf") & has("META-INF/mozilla.rsa")).alias("pkcs7"),
        (has("META-INF/cose.manifest") & has("META-INF/cose.sig")).alias("cose"),
        has("manifest.json").alias("has_web_extension_manifest"),
        has("install.rdf").alias("has_install_rdf"),
        has("chrome.manifest").alias("has_chrome_manifest"),
    )
    out = out.withColumn("legacy_xul_shape", F.col("has_install_rdf") | F.col("has_chrome_manifest"))
    return out.withColumn("unsigned_shape", F.col("has_web_extension_manifest") & ~F.col("pkcs7") & ~F.col("cose"))


def addon_identity(manifests: DataFrame) -> DataFrame:
    """manifests: (file_id, text) of manifest.json to the add-on's author, homepage, name and version; a name that stands for a translation is none."""
    at = lambda k: F.get_json_object("text", f"$.{k}")
    name = at("name")
    return manifests.select("file_id", F.nullif(at("author"), F.lit("")).alias("author"), at("homepage_url").alias("homepage_url"), F.when((name != "") & ~name.startswith("__MSG_"), name).alias("name"), at("version").alias("version"))


def overlays(files: DataFrame, sections: DataFrame) -> DataFrame:
    """files: (file_id, content), sections: (file_id, start, size) to size, ratio and entropy of what follows the last section; files without such bytes give no row."""
    last = sections.groupBy("file_id").agg(F.max(F.col("start") + F.col("size")).alias("overlay_offset")).filter("overlay_offset > 0")
    size = F.octet_length("content").cast("long")
    own = files.join(last, "file_id").filter(size > F.col("overlay_offset")).withColumn("overlay_size", size - F.col("overlay_offset"))
    tail = F.expr("substring(content, CAST(overlay_offset AS INT) + 1)")
    return own.select("file_id", "overlay_offset", "overlay_size", F.round(F.col("overlay_size") / size, 6).alias("overlay_ratio"), F.round(byte_facts(tail)["entropy"], 6).alias("overlay_entropy"))


def superseded(names: DataFrame, current: int) -> DataFrame:
    """names: (name) of stored versions to those `v<number>` that are older than the current one."""
    number = F.try_to_number(F.regexp_extract("name", r"\Av\+?([0-9]{1,10})\z", 1), F.lit("9999999999"))
    return names.filter((number < current) & (number <= 4_294_967_295)).select("name")


def certificate_trust(self_issued: Column, common_name: Column, organisation: Column, subject: Column, issuer: Column) -> Column:
    """`self_signed`, `developer_id`, `platform` or `ca_signed`."""
    names = F.lower(F.concat_ws(" ", organisation, subject, issuer))
    return (
        F.when(self_issued, "self_signed")
        .when(F.coalesce(common_name.startswith("Developer ID"), F.lit(False)), "developer_id")
        .when(names.contains("apple") | names.contains("microsoft"), "platform")
        .otherwise("ca_signed")
    )


#: Bytes of a source's head; endings of files that old configure scripts name in place of a package.
HEAD = 8192
SOURCE_ENDINGS = ["c", "h", "cc", "cpp", "cxx", "in", "sh", "am", "ac", "m4"]


def wordpress_header(text: Column) -> Column:
    """(plugin_name, theme_name, text_domain, version) of the header in a source's head, null without plugin and theme; the first of each field counts."""
    head = F.decode(F.substring(F.encode(text, "UTF-8"), 1, HEAD), "UTF-8")
    rows = F.transform(F.split(head, r"\r?\n"), lambda x: trimmed(F.regexp_replace(x, r"(?U)\A\s*[*#/]*", "")))

    def first(name: str) -> Column:
        own = F.transform(F.filter(rows, lambda x: F.lower(trimmed(F.substring_index(x, ":", 1))).eqNullSafe(F.lit(name)) & x.contains(":")), lambda x: trimmed(F.regexp_replace(x, r"(?s)\A[^:]*:", "")))
        return F.try_element_at(F.filter(own, lambda x: x != ""), F.lit(1))

    plugin, theme = first("plugin name"), first("theme name")
    found = F.struct(plugin.alias("plugin_name"), F.when(plugin.isNull(), theme).alias("theme_name"), first("text domain").alias("text_domain"), first("version").alias("version"))
    return F.when(plugin.isNotNull() | theme.isNotNull(), found)


def autoconf_package(text: Column) -> Column:
    """(name, version) that configure.ac gives to AC_INIT, null where it gives none or a source file's name."""
    inside = F.regexp_extract(text, r"(?sU)\A(?:(?!AC_INIT).)*AC_INIT\s*\(([^)]*)\)", 1)
    args = F.transform(F.split(inside, ",", -1), lambda x: trimmed(F.regexp_replace(trimmed(x), r"\A[\[\]]+|[\[\]]+\z", "")))
    name, version = args[0], F.try_element_at(args, F.lit(2))
    plain = lambda x: (x != "") & ~x.contains("$") & ~x.startswith("m4_")
    file = name.contains("/") | (name.contains(".") & F.substring_index(name, ".", -1).isin(SOURCE_ENDINGS))
    return F.when(plain(name) & ~file, F.struct(name.alias("name"), F.when(plain(version), version).alias("version")))


def configured_package(text: Column) -> Column:
    """(name, version) that a generated configure script assigns in its head; the last of each counts."""
    head = F.substring(text, 1, HEAD)

    def last(key: str) -> Column:
        rows = F.regexp_extract_all(head, F.lit(rf"(?m)^[ \t]*PACKAGE_{key}=([^\r\n]*)"), F.lit(1))
        bare = F.transform(rows, lambda x: trimmed(F.regexp_replace(trimmed(x), r"\A['\"]+|['\"]+\z", "")))
        return F.try_element_at(F.filter(bare, lambda x: x != ""), F.lit(-1))

    name, version = last("TARNAME"), last("VERSION")
    return F.when(name.isNotNull() | version.isNotNull(), F.struct(name.alias("name"), version.alias("version")))
