"""Queries of build paths, parties, recipes, add-ons, overlays, superseded versions and documents' ratios by page."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktum.operators import provenance as P
from faktum.registry import lines, lines_sql, query, rows, table, values

PATHS = (
    (1, 0, "/build/a", "elf.dwarf.comp_dirs"), (1, 1, "/home/me/a", "elf.dwarf.comp_dirs"), (1, 2, "/Users/x", "strings"), (2, 0, "/src/b", "elf.dwarf.comp_dirs"), (2, 1, "D:\\b\\b.pdb", "pe.debug.pdb.path"), (2, 2, "/home/z", "strings"),
    (3, 0, "/home/only", "strings"), (4, 0, None, "strings"), (5, 0, "c:\\USERS\\q\\r.pdb", "pe.debug.pdb.path"), (5, 1, "/home/q", "elf.dwarf.comp_dirs"),
)


@query(
    rf"""WITH c AS (SELECT *, regexp_matches(lower(path), '/users/|/home/|\\users\\') AS home, CASE source WHEN 'pe.debug.pdb.path' THEN 1 WHEN 'elf.dwarf.comp_dirs' THEN 2 ELSE 3 END AS r FROM {lines_sql('file_id, ord, path, source', *PATHS)} WHERE path IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY r = 3, NOT home, r, ord) AS n FROM c) SELECT file_id, path AS build_path, source FROM k WHERE n = 1"""
)
def idy_build_path(spark, sf_dir):
    """IDY-21."""
    return P.build_path(lines(spark, sf_dir, "file_id int, ord int, path string, source string", *PATHS))


AUTHORS = ((1, 0, "A", "a@x", "author"), (1, 1, "A", "a@x", "owner"), (1, 2, "A", None, "maintainer"), (1, 3, None, "a@x", "owner"), (1, 4, None, None, "owner"), (1, 5, "B", "b@x", "owner"), (2, 0, None, "z@y", "author"), (2, 1, None, "z@y", "owner"), (2, 2, "C", None, "owner"), (2, 3, "C", None, "author"))
_AUTHORS = lines_sql("file_id, ord, name, email, role", *AUTHORS)
_AUTHORS_DDL = "file_id int, ord int, name string, email string, role string"


@query(f"SELECT file_id, ord, name, email, role FROM {_AUTHORS} WHERE name IS NOT NULL OR email IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id, name, email ORDER BY ord) = 1")
def idy_parties(spark, sf_dir):
    """IDY-25: a party that comes again, in another role, is one."""
    return P.parties(lines(spark, sf_dir, _AUTHORS_DDL, *AUTHORS))


@query(f"SELECT file_id, list(email ORDER BY o) AS emails FROM (SELECT file_id, email, min(ord) AS o FROM {_AUTHORS} WHERE email IS NOT NULL GROUP BY ALL) GROUP BY file_id")
def idy_emails(spark, sf_dir):
    """IDY-25: the list of addresses."""
    return P.emails(P.parties(lines(spark, sf_dir, _AUTHORS_DDL, *AUTHORS)))


RECIPES = (
    ("one", "# made\npkgbase = tool\n\tpkgver = 1.0\n\turl = https://github.com/Acme/tool\n\tsource = t::https://github.com/other/tool/a.tgz\n\tsource_x86_64 = https://github.com/Acme/tool.git\n\tsource = https://github.com/$own/x\n\tsha256sums = bb\n\tsha256sums = SKIP\n\tmd5sums_x86_64 = aa\n\tdepends = glibc>=2\n\tunknown = 1\n\npkgname = tool\npkgname = tool-docs\n\tempty =\n"),
    ("two", "pkgbase = b\nurl = https://example.org\nsource = local.patch\nb2sums = skip\n"),
)
_FIELDS = (
    ("one", "pkgbase", ["tool"], False), ("one", "pkgver", ["1.0"], False), ("one", "url", ["https://github.com/Acme/tool"], False), ("one", "source", ["t::https://github.com/other/tool/a.tgz", "https://github.com/$own/x"], True), ("one", "source_x86_64", ["https://github.com/Acme/tool.git"], True), ("one", "sha256sums", ["bb", "SKIP"], True),
    ("one", "md5sums_x86_64", ["aa"], True), ("one", "depends", ["glibc>=2"], True), ("one", "pkgname", ["tool", "tool-docs"], True), ("two", "pkgbase", ["b"], False), ("two", "url", ["https://example.org"], False), ("two", "source", ["local.patch"], True), ("two", "b2sums", ["skip"], True),
)


@query("SELECT * FROM " + values("file_id, key, items, is_list", *_FIELDS))
def jsn_recipe_fields(spark, sf_dir):
    """JSN-7: a package recipe's record."""
    return P.recipe_fields(rows(spark, "file_id string, text string", *RECIPES))


@query("SELECT * FROM " + values("file_id, checksums, url_owner, source_owners, owners_differ", ("one", "aa,bb", "acme", ["acme", "other"], True)) + " UNION ALL SELECT 'two', NULL, NULL, [], false")
def jsn_recipe_summary(spark, sf_dir):
    """JSN-7: sums in order without repeats, and owners of the sources against that of the project."""
    return P.recipe_summary(P.recipe_fields(rows(spark, "file_id string, text string", *RECIPES)))


ADDONS = (
    ("signed", "manifest.json"), ("signed", "META-INF/mozilla.sf"), ("signed", "META-INF/mozilla.rsa"), ("cose", "manifest.json"), ("cose", "META-INF/cose.manifest"), ("cose", "META-INF/cose.sig"), ("half", "manifest.json"), ("half", "META-INF/mozilla.sf"), ("old", "install.rdf"), ("old", "chrome.manifest"), ("odd", "sub/manifest.json"), ("odd", None),
)
_HAS = lambda x: f"coalesce(bool_or(path = '{x}'), false)"


@query(
    f"""WITH g AS (SELECT file_id, {_HAS('META-INF/mozilla.sf')} AND {_HAS('META-INF/mozilla.rsa')} AS pkcs7, {_HAS('META-INF/cose.manifest')} AND {_HAS('META-INF/cose.sig')} AS cose, {_HAS('manifest.json')} AS has_web_extension_manifest, {_HAS('install.rdf')} AS has_install_rdf, {_HAS('chrome.manifest')} AS has_chrome_manifest FROM {lines_sql('file_id, path', *ADDONS)} GROUP BY file_id)
SELECT *, has_install_rdf OR has_chrome_manifest AS legacy_xul_shape, has_web_extension_manifest AND NOT pkcs7 AND NOT cose AS unsigned_shape FROM g"""
)
def pkg_addon_shape(spark, sf_dir):
    """PKG-9: signing schemes and shapes."""
    return P.addon_shape(lines(spark, sf_dir, "file_id string, path string", *ADDONS))


ADDON_MANIFESTS = (("a", '{"author": "Me", "name": "Tool", "version": "2.0", "homepage_url": "https://x.org"}'), ("b", '{"author": "", "name": "__MSG_name__"}'), ("c", "not json"))


@query("SELECT * FROM " + values("file_id, author, homepage_url, name, version", ("a", "Me", "https://x.org", "Tool", "2.0"), ("b", None, None, None, None), ("c", None, None, None, None)))
def pkg_addon_identity(spark, sf_dir):
    """PKG-9: who made an add-on."""
    return P.addon_identity(rows(spark, "file_id string, text string", *ADDON_MANIFESTS))


@query(
    """WITH c AS (SELECT doc_id AS file_id, text, strlen(text) AS n, greatest(strlen(text) - doc_id % 50, 1) AS o FROM documents WHERE text <> ''),
b AS (SELECT file_id, n, o, unnest(list_slice(regexp_extract_all(hex(encode(text)), '..'), o + 1, n)) AS x FROM c WHERE n > o), k AS (SELECT file_id, n, o, x, count(*) AS k FROM b GROUP BY ALL)
SELECT file_id, o AS overlay_offset, n - o AS overlay_size, round((n - o) / n, 6) AS overlay_ratio, round(-sum((k / (n - o)) * log2(k / (n - o))) + 0.0, 6) AS overlay_entropy FROM k GROUP BY ALL"""
)
def agg_overlays(spark, sf_dir):
    """AGG-25, over documents as files whose two sections end up to 49 bytes before their end."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select(F.col("doc_id").alias("file_id"), F.encode("text", "UTF-8").alias("content"))
    end = F.greatest(F.octet_length("content") - F.col("file_id") % 50, F.lit(1)).cast("long")
    two = F.array(F.struct(F.lit(0).cast("long").alias("start"), end.alias("size")), F.struct(F.lit(0).cast("long").alias("start"), F.lit(1).cast("long").alias("size")))
    return P.overlays(docs, docs.select("file_id", F.inline(two)))


VERSIONS = (("v1",), ("v12",), ("v13",), ("v012",), ("v",), ("vx",), ("w1",), ("v-1",), ("v99999999999",), (None,))


@query(f"SELECT name FROM (SELECT * FROM {values('name', *VERSIONS)} UNION ALL SELECT CASE p_partkey % 3 WHEN 0 THEN 'w' ELSE 'v' END || p_size FROM part) WHERE regexp_full_match(name, 'v[0-9]+') AND TRY_CAST(name[2:] AS UINTEGER) < 13")
def inc_superseded(spark, sf_dir):
    """INC-5."""
    return P.superseded(rows(spark, "name string", *VERSIONS).unionByName(table(spark, sf_dir, "part").select(F.concat(F.when(F.col("p_partkey") % 3 == 0, "w").otherwise("v"), "p_size").alias("name"))), 13)


PAGED = (
    ("two", b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n2 0 obj <</Type/Page>> endobj\n3 0 obj << /Type /Pages >> endobj\n4 0 obj << /Type /Annot >> endobj\n5 0 obj << /Type/Annot >> endobj\n6 0 obj << /Type /Annot /A << /S /URI /URI (http://x) >> >> endobj\n"),
    ("one", b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj\n"), ("none", b"%PDF-1.4\n1 0 obj << /Type /Annot >> endobj\n"),
)


@query("SELECT * FROM " + values("file_id, page_count, annotation_count, uri_action_count, annotations_per_page, uri_actions_per_page", ("two", 2, 3, 1, 1.5, 0.5), ("one", 1, 0, 0, 0.0, None), ("none", 0, 1, 0, None, None)))
def doc_pdf_ratios(spark, sf_dir):
    """ANM-23."""
    from faktum.functions.documents import pdf_ratios

    own = pdf_ratios(F.col("content"))
    return rows(spark, "file_id string, content binary", *PAGED).select("file_id", *(v.alias(k) for k, v in own.items()))


CERTIFICATES = (
    (1, True, "Developer ID Application: X", "Apple Inc.", "s", "s"), (2, False, "Developer ID Application: X", None, "s", "i"), (3, False, "Microsoft Windows", "Microsoft Corporation", "s", "i"), (4, False, None, None, "CN=x", "CN=Apple Root CA"), (5, False, "x", "Acme", "CN=x", "CN=Some CA"), (6, False, None, None, None, None), (7, None, "a Developer ID", None, "s", "i"),
)


#: Typed ones, and suppliers' with their nations.
_CERTIFICATES = f"""(SELECT * FROM {values('id, self_issued, common_name, organisation, subject, issuer', *CERTIFICATES)} UNION ALL SELECT 1000 + s_suppkey, s_suppkey % 5 = 0, CASE WHEN s_suppkey % 3 = 0 THEN 'Developer ID: ' || s_name ELSE s_name END,
  CASE WHEN s_suppkey % 4 = 0 THEN 'Apple Inc.' END, 'CN=' || s_name, CASE WHEN s_suppkey % 7 = 0 THEN 'CN=Microsoft Root' ELSE 'CN=' || s_nationkey END FROM supplier)"""


@query(
    f"""SELECT id, CASE WHEN self_issued THEN 'self_signed' WHEN common_name LIKE 'Developer ID%' THEN 'developer_id' WHEN regexp_matches(lower(coalesce(organisation, '') || ' ' || coalesce(subject, '') || ' ' || coalesce(issuer, '')), 'apple|microsoft') THEN 'platform' ELSE 'ca_signed' END AS trust
FROM {_CERTIFICATES}"""
)
def idy_certificate_trust(spark, sf_dir):
    """IDY-22: the tier of a signature's certificate."""
    own = rows(spark, "id int, self_issued boolean, common_name string, organisation string, subject string, issuer string", *CERTIFICATES)
    key, name = F.col("s_suppkey"), F.col("s_name")
    own = own.withColumn("id", F.col("id").cast("long")).unionByName(table(spark, sf_dir, "supplier").select(
        (1000 + key).alias("id"), (key % 5 == 0).alias("self_issued"), F.when(key % 3 == 0, F.concat(F.lit("Developer ID: "), name)).otherwise(name).alias("common_name"), F.when(key % 4 == 0, "Apple Inc.").alias("organisation"),
        F.concat(F.lit("CN="), name).alias("subject"), F.when(key % 7 == 0, "CN=Microsoft Root").otherwise(F.concat(F.lit("CN="), "s_nationkey")).alias("issuer"),
    ))
    return own.select("id", P.certificate_trust(*(F.col(c) for c in own.columns[1:])).alias("trust"))


HEADERS = (
    ("plugin", "<?php\n/**\n * Plugin Name: My Tool\n * plugin name: Second\n * Version:  1.2\n * Text Domain: my-tool\n */"), ("theme", "/*\nTheme Name: Blue\nVersion: 3\n*/"), ("neither", "/*\nVersion: 3\n*/"), ("both", "# Theme Name: T\n// Plugin Name: P: x\n"), ("empty", "Plugin Name:\nPlugin Name: later"), ("none", None),
)


@query("SELECT * FROM " + values("file_id, plugin_name, theme_name, text_domain, version", ("plugin", "My Tool", None, "my-tool", "1.2"), ("theme", None, "Blue", None, "3"), ("both", "P: x", None, None, None), ("empty", "later", None, None, None)))
def pkg_wordpress_headers(spark, sf_dir):
    """PKG-15: who a plugin or theme says it is."""
    own = rows(spark, "file_id string, text string", *HEADERS).select("file_id", P.wordpress_header(F.col("text")).alias("w"))
    return own.filter("w IS NOT NULL").select("file_id", "w.*")


INITS = (
    ("quoted", "dnl x\nAC_INIT([GNU Tool], [2.1], [bugs@x])\n"), ("plain", "AC_INIT( tool ,1.0 )"), ("macro", "AC_INIT([t], m4_esyscmd([git describe]))"), ("old", "AC_INIT(dsniff.c)"), ("m4", "AC_INIT([m4], [1.4])"), ("path", "AC_INIT(src/x)"), ("shell", "AC_INIT($NAME, 1)"), ("bare", "AC_INIT\n"), ("later", "AC_INIT\nAC_INIT([x], [1])"), ("none", None),
)


@query("SELECT * FROM " + values("file_id, name, version", ("quoted", "GNU Tool", "2.1"), ("plain", "tool", "1.0"), ("macro", "t", None), ("m4", "m4", "1.4")))
def pkg_autoconf_names(spark, sf_dir):
    """PKG-15: the package that configure.ac names."""
    own = rows(spark, "file_id string, text string", *INITS).select("file_id", P.autoconf_package(F.col("text")).alias("a"))
    return own.filter("a IS NOT NULL").select("file_id", "a.*")


SCRIPTS = (("set", "#!/bin/sh\nPACKAGE_NAME='x'\nPACKAGE_TARNAME='openssh'\nPACKAGE_VERSION='9.1'\n"), ("blank", "PACKAGE_TARNAME=\nPACKAGE_VERSION=\n"), ("half", "PACKAGE_TARNAME='a'\nPACKAGE_VERSION=''\n"), ("twice", '  PACKAGE_TARNAME="a"\nPACKAGE_TARNAME=b \nx PACKAGE_VERSION=1\n'), ("version", "PACKAGE_VERSION=2\n"), ("no", None))


@query("SELECT * FROM " + values("file_id, name, version", ("set", "openssh", "9.1"), ("half", "a", None), ("twice", "b", None), ("version", None, "2")))
def pkg_configured_names(spark, sf_dir):
    """PKG-15: the package that a generated script was made for."""
    own = rows(spark, "file_id string, text string", *SCRIPTS).select("file_id", P.configured_package(F.col("text")).alias("a"))
    return own.filter("a IS NOT NULL").select("file_id", "a.*")


@query(
    """WITH k AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT user_id, event_type, list(event_id ORDER BY place) FILTER (place <= 3) AS shown, any_value(greatest(n - 3, 0)) AS hidden FROM k GROUP BY user_id, event_type"""
)
def snk_previews(spark, sf_dir):
    """SNK-2: the first few of each list and how many more there are."""
    from faktum.plans.views import previews

    return previews(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", 3)


def _gem() -> bytes:
    import gzip
    import io
    import tarfile

    dependency = "- !ruby/object:Gem::Dependency\n  name: {}\n  type: :{}\n"
    body = gzip.compress(("--- !ruby/object:Gem::Specification\nname: tool\nversion: !ruby/object:Gem::Version\n  version: 1.2.0\ndependencies:\n" + dependency.format("rake", "development") + dependency.format("rack", "runtime") + dependency.format("faraday-multipart", "runtime")).encode())
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        i = tarfile.TarInfo("metadata.gz")
        i.size = len(body)
        t.addfile(i, io.BytesIO(body))
    return out.getvalue()


_VSIX = b"<PackageManifest><Metadata><Identity Id='v'/></Metadata><Dependencies><Dependency Id='ms.python'/><Dependency Id='plain'/><Dependency Id='.x'/><Dependency Id='a.b.c'/></Dependencies></PackageManifest>"


@query("SELECT * FROM " + values("file_id, locator_type, locator, kind, source", ("g", "purl", "pkg:gem/rack", "dependency", "gem.runtime_dependencies"), ("g", "purl", "pkg:gem/faraday-multipart", "dependency", "gem.runtime_dependencies"), ("v", "purl", "pkg:vscode/ms/python", "dependency", "vsix.dependencies"), ("v", "purl", "pkg:vscode/a/b.c", "dependency", "vsix.dependencies")))
def ref_packages(spark, sf_dir):
    """REF-7: what gems and editor extensions depend on, from their bytes."""
    from faktum.operators.references import package_references
    from faktum.sources.packages import package_facts

    return package_references(package_facts(rows(spark, "file_id string, file_type string, content binary", ("g", "gem", _gem()), ("v", "vsix_manifest", _VSIX)))).drop("ord")
