"""Queries of identification, archives, sections, records and identity, and their relational analogs on the star tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.functions import identity as I
from faktum.functions import languages
from faktum.operators import archive as A
from faktum.operators import file_types, identify
from faktum.operators import records as R
from faktum.operators import sections as S
from faktum.registry import literal, query, rows, spread, table, values

FILES = (
    ("a.wasm", b"\0asm\x01\0\0\0"), ("x", b"\x7fELF\x02\x01"), ("setup.txt", b"MZ\x90\0"), ("d.cab", b"MSCF\0\0"), ("A.class", b"\xca\xfe\xba\xbe\0\0\0\x34"), ("fat", b"\xca\xfe\xba\xbe\0\0\0\x02"), ("m", b"\xcf\xfa\xed\xfe\x07\0"),
    ("p.jpg", b"\xff\xd8\xff\xe0"), ("p.png", b"\x89PNG\r\n\x1a\n"), ("d.doc", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("d.msi", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"), ("r.rar", b"Rar!\x1a"), ("t.rtf", b"{\\rtf1"), ("t.pdf", b"%PDF-1.7"),
    ("c.dex", b"dex\n035\0"), ("e.beam", b"FOR1\0\0\0\0BEAM"), ("h.chm", b"ITSF\x03"), ("p.plist", b"bplist00"), ("q.pkg", b"xar!\0"), ("e.crx", b"Cr24\x03"), ("r.rpm", b"\xed\xab\xee\xdb\x03"), ("z.7z", b"7z\xbc\xaf\x27\x1c"),
    ("o.a", b"!<arch>\nfoo.o/          "), ("o.deb", b"!<arch>\ndebian-binary   "), ("z.gz", b"\x1f\x8b\x08"), ("z.tar.gz", b"\x1f\x8b\x08"), ("z.apk", b"\x1f\x8b\x08"), ("z.crate", b"\x1f\x8b\x08"), ("z.xz", b"\xfd7zXZ"), ("z.txz", b"\xfd7zXZ"),
    ("z.tbz2", b"BZh9"), ("z.zst", b"\x28\xb5\x2f\xfd"), ("z.xbps", b"\x28\xb5\x2f\xfd"), ("a.jar", b"PK\x03\x04"), ("a.whl", b"PK\x03\x04"), ("a.apk", b"PK\x03\x04"), ("a.docx", b"PK\x03\x04"), ("a.zip", b"PK\x03\x04[Content_Types].xml"),
    ("a", b"PK\x03\x04[Content_Types].xml"), ("b", b"PK\x03\x04application/vnd.oasis.opendocument.text"), ("s", b"#!/bin/bash\necho"), ("s.py", b"#!/usr/bin/env python3\n"), ("s2.py", b"#!/bin/sh\nimport x"), ("n.js", b"#!/usr/bin/env  node\n"), ("w", b"#!/opt/unknown\n"),
    ("i.svg", b"<svg xmlns='x'>"), ("i.xml", b"<?xml version='1.0'?><a/>"), ("i2.xml", b"<?xml version='1.0'?>\n<svg >"), ("l.plist", b"<?xml?><!DOCTYPE plist>"), ("f", b"<rss version='2'>"), ("p.php", b"<?php echo 1;"), ("m.pyc", b"\x42\x0d\x0d\x0a"),
    (".github/ci.yml", b"name: x\non: push\njobs:\n  a: 1\n"), ("x.yml", b"on: 1\n"), ("package.json", b"{}"), ("go.mod", b"module x"), ("manifest.json", b'{"manifest_version": 3, "permissions": []}'), ("poetry.lock", b"xx"), ("PKG-INFO", b"Name: x"),
    ("Dockerfile", b"xx"), ("Makefile.am", b"xx"), ("LICENSE", b"MIT license"), ("COPYING.md", b"text"), ("lib.so.6", b"zz"), ("a.rs", b"fn main"), ("x.unknownext", b"zz"), ("h.html", b"<p>hi"), ("h2.html", b"plain words"), ("y.toml", b"a=1"), ("data.pkl", b"\x80\x04x"), ("e", b""),
    ("k", b"const a = require('x');\nmodule.exports = a; var b = 1; let c = 2"), ("script", b"use strict;\nuse warnings;\nmy $x = 1;\n"), ("prose", b"a plain letter with nothing else in it"), ("q.zip", b"import os\nif __name__ == 'x': subprocess.run()"),
)

_MAGIC = values("path, content", *FILES)
_ARMS = " ".join(f"WHEN h LIKE '{x}%' THEN '{label}'" for x, label in identify.MAGIC)


@query(
    f"""SELECT path, CASE {_ARMS} END AS first_bytes_type, regexp_extract(path, '[^/]*$') AS basename,
  lower(regexp_extract(regexp_extract(path, '[^/]*$'), '.\\.([^.]*)$', 1)) AS ext, octet_length(content) AS length FROM (SELECT path, content, hex(content[1:64]) AS h FROM (SELECT doc_id || '/' || path AS path, content || encode(coalesce(text, '')) AS content FROM documents JOIN (SELECT row_number() OVER () - 1 AS k, * FROM {_MAGIC}) ON doc_id % {len(FILES)} = k))"""
)
def id_first_bytes(spark, sf_dir):
    """The table of first bytes alone, with the parts of the path, on documents behind first bytes of files."""
    cases = F.broadcast(rows(spark, "k long, case string, head binary", *((k, *x) for k, x in enumerate(FILES))))
    files = table(spark, sf_dir, "documents").join(cases, F.col("doc_id") % len(FILES) == F.col("k"))
    files = files.select(F.concat("doc_id", F.lit("/"), "case").alias("path"), F.concat("head", F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("content"))
    h = F.hex(F.substring("content", 1, 64))
    arms = identify.case([(h.startswith(x), F.lit(label)) for x, label in identify.MAGIC])
    return files.select("path", arms.alias("first_bytes_type"), identify.basename(F.col("path")).alias("basename"), identify.extension(F.col("path")).alias("ext"), F.octet_length("content").alias("length"))


@query()
def id_identify(spark, sf_dir):
    """The whole cascade over the truth table of files."""
    files = rows(spark, "path string, content binary", *FILES).withColumn("forced_type", F.lit(None).cast("string"))
    return identify.identify(files).drop("content", "forced_type")


@query(
    """SELECT page_id, CASE WHEN regexp_matches(html, '^<svg[ >]') OR (regexp_matches(html, '^<(\\?xml|!DOCTYPE)') AND regexp_matches(left(html, 1024), '<svg[ >]')) THEN 'svg' WHEN html LIKE '<?xml%' THEN 'xml' END AS markup,
  regexp_matches(lower(left(html, 4096)), '<!doctype html|<html|<head|<body|<script|<div|<span|<p>|<meta') AS looks_like_html, regexp_matches(left(html, 256), '<plist|<!DOCTYPE plist') AS is_plist FROM pages"""
)
def id_markup(spark, sf_dir):
    head = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", identify.markup(head).alias("markup"), identify.looks_like_html(head).alias("looks_like_html"), identify.is_plist(head).alias("is_plist"))


_INTERPRETERS = " ".join(f"WHEN n IN ({', '.join(literal(x) for x in own.split())}) THEN '{label}'" for label, own in identify.SHEBANGS.items())
LINES = ("#!/bin/sh", "#!/usr/bin/env python3 -u", "#!/usr/bin/env\tnode", "#!/usr/local/bin/lua5", "#! /bin/bash", "plain", "#!/usr/bin/perl -w", "#!zsh", "#!/bin/make -f")


@query(
    rf"""SELECT doc_id, s, CASE {_INTERPRETERS} END AS language FROM (SELECT doc_id, s, regexp_extract(CASE WHEN regexp_matches(s, '^#!/usr/bin/env[ \t]') THEN regexp_replace(s, '^#!/usr/bin/env[ \t]+', '') ELSE regexp_replace(s[3:], '^.*/', '') END, '^[^ \t]*') AS n FROM (SELECT doc_id, {literal(LINES)}[1 + doc_id % {len(LINES)}] AS s FROM documents) WHERE s LIKE '#!%')"""
)
def id_shebang(spark, sf_dir):
    """ID-15: documents behind first lines of scripts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", _picked(LINES, F.col("doc_id")).alias("s"), "text").filter("s LIKE '#!%'")
    return docs.select("doc_id", "s", identify.shebang(F.concat("s", F.lit("\n"), F.coalesce("text", F.lit("")))).alias("language"))


@query(
    "SELECT * FROM " + values("label, grp, archive_format, compression", *((x, g, {v: k for k, o in file_types.ARCHIVES.items() for v in o.split()}.get(x), {v: k for k, o in file_types.CODECS.items() for v in o.split()}.get(x)) for g, own in file_types.GROUPS.items() for x in own.split()))
)
def id_file_types(spark, sf_dir):
    return file_types.file_types(spark).select("label", "grp", "archive_format", "compression")


def _count(needle: str) -> str:
    """How often a needle stands in t, overlaps included: where it begins and ends with the same character, that one is doubled in t and inside the needle, so that neighbours share nothing."""
    edge = needle[0]
    assert not any(needle.startswith(needle[-k:]) for k in range(2, len(needle)))
    text, inner = ("t", needle) if needle[-1] != edge else (f"replace(t, {literal(edge)}, {literal(2 * edge)})", edge + needle[1:-1].replace(edge, 2 * edge) + edge)
    return f"(length({text}) - length(replace({text}, {literal(inner)}, ''))) // {len(inner)}"


#: JavaScript's marks that ask for something around them.
_AROUND = {"===": "len(list_filter(regexp_extract_all(t, '=+'), lambda x: length(x) = 3))", "document.": r"len(regexp_extract_all(t, 'document\.[a-z]'))", "window.": r"len(regexp_extract_all(t, 'window\.[a-z]'))"}
_SCORES = ", ".join(f"least(65535, {' + '.join(f'{w} * ' + (_AROUND.get(x) or _count(x)) for w, xs in own.items() for x in xs)}) AS {language}" for language, own in languages.PATTERNS.items())
#: Three marks of languages by a document's number, before its text; every fifth time behind it, after much white space.
_MARKS = [x for own in languages.PATTERNS.values() for xs in own.values() for x in xs]
_MARKED = "concat(m[1 + doc_id % {n}], ' x ', m[1 + (doc_id * 31) % {n}], '; ', m[1 + (doc_id // 7) % {n}], 'y')".format(n=len(_MARKS))
_BOTH = f"""SELECT 'documents' AS source, doc_id AS id, text AS t FROM documents UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'marked', doc_id, CASE WHEN doc_id % 5 = 0 THEN concat(repeat(' ', 4200), text, ' ', {_MARKED}) ELSE concat({_MARKED}, ' ', text) END FROM documents, (SELECT {literal(_MARKS)} AS m)"""


def _contents(spark, sf_dir):
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    marks, n = F.array(*map(F.lit, _MARKS)), len(_MARKS)
    own = F.concat(*(F.element_at(marks, (1 + k % n).cast("int")) if not isinstance(k, str) else F.lit(k) for k in (F.col("doc_id"), " x ", F.col("doc_id") * 31, "; ", F.floor(F.col("doc_id") / 7), "y")))
    text = F.coalesce("text", F.lit(""))
    marked = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit(" "), 4200), text, F.lit(" "), own)).otherwise(F.concat(own, F.lit(" "), text))
    plain = docs.select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"), F.col("text").alias("t"))
    return spread(plain.unionByName(pages.select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), F.col("html").alias("t"))).unionByName(docs.select(F.lit("marked").alias("source"), F.col("doc_id").alias("id"), marked.alias("t"))))


@query(f"WITH d AS ({_BOTH}), s AS (SELECT source, id, {_SCORES} FROM d) SELECT source, id, language, CAST(score AS BIGINT) AS score FROM (UNPIVOT s ON {', '.join(languages.LANGUAGES)} INTO NAME language VALUE score) WHERE score > 0")
def id_heuristic_scores(spark, sf_dir):
    """REL-J3: overlapping hits of all patterns in whole texts, by language."""
    return _contents(spark, sf_dir).select("source", "id", F.explode(languages.scores(F.encode("t", "UTF-8"))).alias("x")).select("source", "id", "x.*")


_WHOLE = lambda cut: "coalesce(" + ", ".join(f"try(decode(b[{cut(k)}]))" for k in range(4)) + ")"  # noqa: E731  # a cut may part a character
_WHITE = r"[ \t\n\x0C\r]"
_TRIM = rf"regexp_replace(regexp_replace(x, '^{_WHITE}+', ''), '{_WHITE}+$', '')"
_PHP = r"(len(list_filter(regexp_extract_all(x, '(?s)<\?.{0,3}'), lambda y: lower(y) <> '<?xml')) > 0 OR (NOT regexp_matches(x, '(?i)<\?xml') AND contains(x, '?>')))"
_DECIDED = rf"""
WITH d AS ({_BOTH}), b AS (SELECT source, id, t, encode(t) AS b FROM d WHERE t IS NOT NULL),
h AS (SELECT source, id, octet_length(b) AS n, {_WHOLE(lambda k: f"1:{languages.HEAD - k}")} AS head, {_WHOLE(lambda k: f"greatest(octet_length(b) - {languages.TAIL - 1 - k}, 1):octet_length(b)")} AS tail FROM b),
l AS (SELECT *, n > {languages.HEAD} AND length(regexp_replace(head, '{_WHITE}', '', 'g')) < {languages.LITTLE} AS little,
      list_filter(list_transform(string_split(CASE WHEN n >= {languages.HEAD} THEN regexp_replace(head, '(?s)(\A|\n)[^\n]*\z', '') ELSE head END, chr(10)), lambda x: {_TRIM}), lambda x: x <> '' AND NOT x LIKE '#%') AS lines,
      list_filter(list_transform(string_split(head, chr(10)), lambda x: {_TRIM}), lambda x: x <> '' AND NOT x LIKE '#%')[1] AS line FROM h),
p AS (SELECT source, id, head AS t FROM l UNION ALL SELECT source, id, tail FROM l WHERE little),
s AS (SELECT source, id, {_SCORES} FROM p),
u AS (SELECT source, id, language, max(score) AS score FROM (UNPIVOT s ON {', '.join(languages.LANGUAGES)} INTO NAME language VALUE score) GROUP BY ALL),
r AS (SELECT source, id, arg_max(language, score) AS language, max(score) AS best, max(score, 2)[2] AS second FROM u GROUP BY ALL),
g AS (SELECT *, CASE WHEN little THEN [head, tail] ELSE [head] END AS parts FROM r JOIN l USING (source, id))
SELECT source, id, language FROM g WHERE n >= 4 AND best >= {languages.LEAST_SCORE} AND second * 100 // best <= {languages.NEAR}
  AND (head LIKE '#!%' OR NOT ((regexp_matches(head, '^{_WHITE}*[{{\[]') AND contains(head, '":')) OR (len(lines) >= 5 AND 10 * len(list_filter(lines, lambda x: regexp_matches(x, '^(---$|\.\.\.$|-$|--- |- |[A-Za-z0-9_\-./"'']+:( |$))'))) >= 7 * len(lines))))
  AND CASE language WHEN 'javascript' THEN len(list_filter(parts, lambda x: regexp_matches(x, '[;{{}}]'))) > 0 WHEN 'php' THEN len(list_filter(parts, lambda x: {_PHP})) > 0
      WHEN 'dockerfile' THEN upper(regexp_extract(line, '^[^ \t\x0C\r]*')) IN ('FROM', 'ARG') ELSE true END
"""


@query(_DECIDED)
def id_heuristic_types(spark, sf_dir):
    """ID-18: the language that the beginning (or else the end) of a text decides for, if any."""
    return _contents(spark, sf_dir).select("source", "id", languages.language(F.encode("t", "UTF-8")).alias("language")).filter("language IS NOT NULL")


# archives

MEMBERS = (
    (1, 0, "a/", 0, 0, "directory", "stored", 0o755, 1_600_000_000, None, False, 0, 0), (1, 1, "a/run.sh", 100, 50, "file", "deflate", 0o755, 1_600_000_000, 11, False, 4, 0), (1, 2, "a/report.pdf.exe", 4000, 100, "file", "deflate", 0o644, 1_600_000_000, 12, True, 4, 3),
    (1, 3, "../etc/passwd", 10, 10, "file", "stored", 0o666, None, 12, False, 0, 0), (1, 4, ".hidden/x", 5, 5, "file", "stored", 0o4755, 4_200_000_000, 13, False, 0, 0), (1, 5, "a/run.sh", 100, 50, "file", "deflate", 0o755, 1_600_000_000, 11, False, 4, 0),
    (2, 0, "lib/libx.so", 9, 9, "file", "stored", None, 5, 1, False, 0, 0), (2, 1, "opt/liby.so", 9, 0, "file", "stored", None, 5, 2, False, 0, 0), (2, 2, "pаypal.zip", 7, 7, "file", "stored", 0o2755, 6, 3, False, 0, 0), (2, 3, "x‮gnp.exe", 7, 7, "file", "stored", 0o1777, 7, None, False, 0, 0),
    (2, 4, "__MACOSX/._a", 1, 1, "file", "stored", None, None, None, False, 0, 0), (2, 5, "ln", 0, 0, "symlink", "stored", 0o777, None, None, False, 0, 0), (2, 6, "bin/tool.exe", 3, 1, "file", "lzma-x", None, 8, 9, False, 0, 0), (3, 0, "only", 0, 0, "file", "stored", None, None, None, False, 0, 0),
)
_MEMBER_COLUMNS = "file_id, ord, path, size_bytes, compressed_bytes, entry_type, method, mode, mtime_unix, crc32, encrypted, extra_bytes, comment_bytes"
#: What a line of an order becomes as a member of an archive: parts of its path and its mode, by its numbers.
_FOLDERS = ("", "bin/", "lib/", "../", ".cfg/", "usr/lib/x/", "__MACOSX/", "a/b/", "/abs/")
_ENDINGS = (".txt", ".exe", ".so", ".sh", ".pdf.exe", ".zip", ".py", "", ".jpg.scr", ".DLL", "\u0430.js", "\u202egnp.exe")
_MODES = (None, 0o644, 0o755, 0o4755, 0o666, 0o2755, 0o1777)
_LINE_MEMBERS = f"""SELECT l_orderkey AS file_id, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey AS ord, {literal(_FOLDERS)}[1 + l_suppkey % {len(_FOLDERS)}] || 'm' || (l_partkey % 7) || {literal(_ENDINGS)}[1 + l_partkey % {len(_ENDINGS)}] AS path,
  CAST(l_quantity AS BIGINT) * 10 AS size_bytes, CAST(l_quantity AS BIGINT) * 10 // l_linenumber AS compressed_bytes, CASE WHEN l_partkey % 11 = 0 THEN 'symlink' WHEN l_suppkey % 9 = 0 THEN 'directory' ELSE 'file' END AS entry_type,
  CASE l_linestatus WHEN 'O' THEN 'deflate' ELSE 'lzma-x' END AS method, {literal(_MODES)}[1 + (l_partkey + l_suppkey) % {len(_MODES)}] AS mode, CASE WHEN l_linenumber % 5 = 4 THEN NULL WHEN l_partkey % 13 = 0 THEN 4200000000 ELSE epoch(l_shipdate)::BIGINT // 5184000 END AS mtime_unix,
  CASE WHEN l_linenumber % 6 < 5 THEN l_partkey % 50 END AS crc32, l_returnflag = 'R' AS encrypted, l_linenumber % 3 AS extra_bytes, l_linenumber % 2 * 5 AS comment_bytes FROM lineitem"""
_MEMBERS = f"(SELECT * FROM {values(_MEMBER_COLUMNS, *MEMBERS)} UNION ALL {_LINE_MEMBERS}) AS t"
_LIST = lambda xs: "(" + ", ".join(literal(x) for x in xs) + ")"
_PREFIX = lambda xs: "(" + " OR ".join(f"starts_with(path, {literal(x)})" for x in xs) + ")"


def _picked(xs: tuple, number) -> "F.Column":
    return F.element_at(F.array(*map(F.lit, xs)), (1 + number % len(xs)).cast("int"))


def _members(spark, sf_dir):
    """Typed members, and the lines of orders as members of archives."""
    line, part, supplier = F.col("l_linenumber").cast("long"), F.col("l_partkey"), F.col("l_suppkey")
    size = F.col("l_quantity").cast("long") * 10
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), (line * 1_000_000_000 + part * 10_000 + supplier).alias("ord"), F.concat(_picked(_FOLDERS, supplier), F.lit("m"), part % 7, _picked(_ENDINGS, part)).alias("path"), size.alias("size_bytes"), F.floor(size / line).alias("compressed_bytes"),
        F.when(part % 11 == 0, "symlink").when(supplier % 9 == 0, "directory").otherwise("file").alias("entry_type"), F.when(F.col("l_linestatus") == "O", "deflate").otherwise("lzma-x").alias("method"), _picked(_MODES, part + supplier).cast("long").alias("mode"),
        F.when(line % 5 == 4, F.lit(None)).when(part % 13 == 0, 4_200_000_000).otherwise(F.floor(F.unix_timestamp("l_shipdate") / 5_184_000)).cast("long").alias("mtime_unix"), F.when(line % 6 < 5, part % 50).alias("crc32"),
        (F.col("l_returnflag") == "R").alias("encrypted"), (line % 3).alias("extra_bytes"), (line % 2 * 5).alias("comment_bytes"),
    )
    return rows(spark, "file_id long, ord long, path string, size_bytes long, compressed_bytes long, entry_type string, method string, mode long, mtime_unix long, crc32 long, encrypted boolean, extra_bytes long, comment_bytes long", *MEMBERS).unionByName(lines)


_ARC = rf"""
WITH b AS (SELECT *, split_part(path, '/', -1) AS base FROM {{members}}),
e AS (SELECT *, CASE WHEN contains(base, '.') THEN split_part(lower(base), '.', -1) ELSE '' END AS ext, regexp_extract(lower(base), '\.([^.]*)\.[^.]*$', 1) AS inner_ext, entry_type <> 'directory' AS file FROM b),
c AS (SELECT *, ext IN {_LIST(A.EXECUTABLE)} AS ex, CASE WHEN ext IN ('so', 'dylib') AND NOT {_PREFIX(A.IN_LIB)} THEN true WHEN ext IN ('exe', 'dll', 'sys', 'scr') THEN NOT contains(lower(path), 'bin/') WHEN ext IN ('bin', 'elf') THEN NOT {_PREFIX(A.IN_BIN)} ELSE false END AS mis FROM e)
SELECT file_id, count(*) AS member_count, count(*) FILTER (file) AS file_count, count(*) FILTER (NOT file) AS directory_count, sum(size_bytes)::BIGINT AS total_uncompressed, sum(compressed_bytes)::BIGINT AS total_compressed,
  round(CASE WHEN sum(size_bytes) > 0 THEN sum(compressed_bytes) / sum(size_bytes) END, 6) AS compression_ratio,
  count(*) FILTER (mode & 2048 <> 0) AS setuid_count, count(*) FILTER (mode & 1024 <> 0) AS setgid_count, count(*) FILTER (mode & 512 <> 0) AS sticky_count, count(*) FILTER (mode & 2 <> 0) AS world_writable_count,
  count(*) FILTER (entry_type = 'symlink') AS symlink_count, count(*) FILTER (encrypted) AS encrypted_count, max(strlen(path))::INTEGER AS max_filename_length,
  count(*) FILTER (len(list_filter(string_split(path, '/'), lambda x: x LIKE '.%' AND x NOT IN ('.', '..'))) > 0) AS hidden_count,
  count(*) FILTER (list_contains(string_split(path, '/'), '..') OR path LIKE '/%') AS traversal_count, count(*) FILTER (ext IN {_LIST(A.SCRIPT)}) AS script_count,
  count(*) FILTER (strlen(path) <> length(path)) AS unicode_count, count(*) FILTER (regexp_matches(path, '[{A.HOMOGLYPHS}]')) AS homoglyph_count, count(*) FILTER (ex AND inner_ext IN {_LIST(A.HARMLESS)}) AS double_extension_count,
  count(*) FILTER (regexp_matches(path, '[\x{{202a}}-\x{{202e}}\x{{2066}}-\x{{2069}}]')) AS rtlo_count, count(*) FILTER (ext IN {_LIST(A.ARCHIVE)}) AS nested_archive_count, count(*) FILTER (mis) AS misplaced_count,
  count(*) FILTER (path LIKE '\_\_MACOSX/%' ESCAPE '\' OR base IN ('.DS_Store', 'Thumbs.db', 'desktop.ini')) AS noise_count,
  count(*) FILTER (file AND (ex OR coalesce(mode & 73 <> 0, false))) AS executable_count, round(max(CASE WHEN file AND compressed_bytes > 0 THEN size_bytes / compressed_bytes END), 6) AS zip_bomb_ratio,
  sum(extra_bytes)::BIGINT AS extra_field_size, count(*) FILTER (comment_bytes > 0) AS entry_comment_count, sum(comment_bytes)::BIGINT AS entry_comment_size,
  count(path) - count(DISTINCT path) AS duplicate_member_count, count(crc32) FILTER (size_bytes > 0) - count(DISTINCT crc32) FILTER (size_bytes > 0) AS crc_collision_count, count(*) FILTER (mtime_unix IS NULL) AS sentinel_mtime_count,
  max(mtime_unix) - min(mtime_unix) AS mtime_spread_seconds, count(DISTINCT mtime_unix) AS mtime_unique_count, round(CASE WHEN count(mtime_unix) > 0 THEN count(DISTINCT mtime_unix) / count(mtime_unix) END, 6) AS mtime_unique_ratio,
  count(*) FILTER (mtime_unix > 4102444800) AS future_mtime_count FROM c GROUP BY file_id
"""


def member_metrics_sql(members: str) -> str:
    return _ARC.replace("{members}", members)


@query(member_metrics_sql(_MEMBERS))
def arc_member_metrics(spark, sf_dir):
    return A.member_metrics(_members(spark, sf_dir))


@query(f"SELECT file_id, 'entry_type' AS what, replace(entry_type, '-', '_') AS kind, count(*) AS n FROM {_MEMBERS} GROUP BY ALL UNION ALL SELECT file_id, 'method', replace(method, '-', '_'), count(*) FROM {_MEMBERS} GROUP BY ALL")
def arc_histograms(spark, sf_dir):
    m = _members(spark, sf_dir)
    own = lambda c: A.histogram(m, c).select("file_id", F.lit(c).alias("what"), F.col(c).alias("kind"), "n")
    return own("entry_type").unionByName(own("method"))


def _dominant(source: str, key: str, bucket: str) -> str:
    return f"""WITH c AS (SELECT {key}, {bucket} AS b, count(*) AS n FROM {source} GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n DESC, b DESC NULLS LAST) AS r, sum(n) OVER (PARTITION BY {key}) AS m FROM c)
SELECT {key}, b AS dominant, n AS dominant_count, round(n / m, 6) AS dominant_fraction, CASE WHEN n / m > 0.5 AND n < m THEN CAST(m - n AS BIGINT) END AS outlier_count FROM t WHERE r = 1"""


@query(_dominant(_MEMBERS, "file_id", "mtime_unix"))
def arc_dominant_mtime(spark, sf_dir):
    return A.dominant(_members(spark, sf_dir), "file_id", "mtime_unix")


@query(_dominant("lineitem", "l_suppkey", "date_trunc('month', l_shipdate)"))
def rel_dominant_month(spark, sf_dir):
    """REL-A4 on shipments: the commonest month of each supplier."""
    return A.dominant(table(spark, sf_dir, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate")), "l_suppkey", "month")


@query(
    f"""WITH c AS (SELECT file_id, mtime_unix AS b, count(*) AS n FROM {_MEMBERS} GROUP BY ALL), t AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY n DESC, b DESC NULLS LAST) AS r, sum(n) OVER (PARTITION BY file_id) AS m FROM c)
SELECT x.file_id, x.path, CAST(row_number() OVER (PARTITION BY x.file_id ORDER BY ord) AS INTEGER) AS rank FROM {_MEMBERS.removesuffix(" AS t")} AS x JOIN t ON x.file_id = t.file_id AND t.r = 1 WHERE t.n / t.m > 0.5 AND t.n < t.m AND x.mtime_unix IS DISTINCT FROM t.b"""
)
def arc_outliers(spark, sf_dir):
    return A.outliers(_members(spark, sf_dir), "file_id", "mtime_unix", "ord").select("file_id", "path", "rank")


# sections

SECTIONS = (
    (1, 0, ".text", 1024, 4096, ["executable", "read"], 6.1), (1, 1, ".data", 5120, 1024, ["writable", "read"], 3.2), (1, 2, "UPX0", 6144, 512, ["executable", "writable"], 7.9), (1, 3, ".bss", 6656, 0, ["writable"], None), (2, 0, "__TEXT,__text", 0, 100, ["execinstr"], 5.0), (2, 1, "__DATA,__odd", 100, 300, ["write"], 5.0), (3, 0, ".rodata", 10, 20, [], None),
)
LENGTHS = ((1, 9000), (2, 400), (3, 64))
_SECTION_NAMES = (".text", ".data", "UPX0", "__DATA,__odd", ".rodata", ".bss")
_FLAGS = (["executable", "read"], ["writable", "read"], ["executable", "writable"], ["read"], ["execinstr"])
_SECTIONS = f"""(SELECT * FROM {values("file_id, ord, name, file_offset, file_size, flags, entropy", *SECTIONS)} UNION ALL SELECT l_orderkey, l_linenumber::BIGINT * 1000000000 + l_partkey * 10000 + l_suppkey, {literal(_SECTION_NAMES)}[1 + l_partkey % {len(_SECTION_NAMES)}], l_linenumber * 700, CAST(l_quantity AS BIGINT) * 10,
  {literal(_FLAGS)}[1 + l_suppkey % {len(_FLAGS)}], CASE WHEN l_linenumber % 4 < 3 THEN (l_partkey % 80)::DOUBLE / 9.7::DOUBLE END FROM lineitem WHERE l_orderkey > 9) AS t"""
_LENGTHS = f"(SELECT * FROM {values('file_id, length', *LENGTHS)} UNION ALL SELECT o_orderkey, 2000 + o_custkey FROM orders WHERE o_orderkey > 9) AS t"
_KNOWN = _LIST(S.STANDARD)


@query(
    rf"""WITH s AS (SELECT *, list_has_any(flags, ['executable', 'execinstr']) AS x, list_has_any(flags, ['writable', 'write']) AS w, regexp_replace(regexp_replace(name, '^.*,', ''), '^[._]+', '') AS bare FROM {_SECTIONS}),
a AS (SELECT file_id, count(*) AS count, round(max(entropy), 6) AS entropy_max, (list(name ORDER BY entropy DESC, ord) FILTER (entropy IS NOT NULL))[1] AS entropy_max_section, round(avg(entropy), 6) AS entropy_mean, count(*) FILTER (x) AS executable_count, count(*) FILTER (w) AS writable_count, count(*) FILTER (x AND w) AS executable_writable_count,
  nullif(coalesce(sum(file_size) FILTER (x), 0), 0)::BIGINT AS code_size, count(*) FILTER (bare NOT IN {_KNOWN}) AS nonstandard_count, round(CASE WHEN count(entropy) >= 2 THEN var_pop(entropy) END, 6) AS entropy_variance,
  round(sum(entropy * file_size) FILTER (x AND entropy IS NOT NULL) / nullif(sum(file_size) FILTER (x AND entropy IS NOT NULL), 0), 6) AS code_entropy,
  round(sum(entropy * file_size) FILTER (w AND NOT x AND entropy IS NOT NULL) / nullif(sum(file_size) FILTER (w AND NOT x AND entropy IS NOT NULL), 0), 6) AS data_entropy,
  round(coalesce(sum(file_size) FILTER (x), 0) / nullif(coalesce(sum(file_size) FILTER (x), 0) + coalesce(sum(file_size) FILTER (w AND NOT x), 0), 0), 6) AS code_to_data_ratio, max(file_size) AS largest, max(file_offset + file_size) AS fin FROM s GROUP BY file_id),
b AS (SELECT file_id, x, count(*) AS k FROM (SELECT file_id, unnest(regexp_extract_all(hex(encode(name)), '..')) AS x FROM s) GROUP BY ALL), ne AS (SELECT file_id, round(-sum((k / m) * log2(k / m)) + 0.0, 6) AS name_entropy FROM (SELECT *, sum(k) OVER (PARTITION BY file_id) AS m FROM b) GROUP BY file_id)
SELECT a.* EXCLUDE (largest, fin), name_entropy, round(largest / length, 6) AS largest_section_ratio, CASE WHEN length > fin THEN 1.0::DOUBLE END AS has_overlay, CASE WHEN length > fin THEN CAST(length - fin AS BIGINT) END AS overlay_size, round(CASE WHEN length > fin THEN (length - fin) / length END, 6) AS overlay_ratio FROM a JOIN {_LENGTHS} ON a.file_id = t.file_id LEFT JOIN ne ON ne.file_id = a.file_id"""
)
def agg_sections(spark, sf_dir):
    """AGG over typed sections, and over the lines of orders as sections of files."""
    s = rows(spark, "file_id long, ord long, name string, file_offset long, file_size long, flags array<string>, entropy double", *SECTIONS)
    line, part = F.col("l_linenumber").cast("long"), F.col("l_partkey")
    flags = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in _FLAGS)), (1 + F.col("l_suppkey") % len(_FLAGS)).cast("int"))
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey > 9").select(
        F.col("l_orderkey").alias("file_id"), (line * 1_000_000_000 + part * 10_000 + F.col("l_suppkey")).alias("ord"), _picked(_SECTION_NAMES, part).alias("name"), (line * 700).alias("file_offset"), (F.col("l_quantity").cast("long") * 10).alias("file_size"), flags.alias("flags"), F.when(line % 4 < 3, part % 80 / F.lit(9.7)).alias("entropy")
    )
    lengths = table(spark, sf_dir, "orders").filter("o_orderkey > 9").select(F.col("o_orderkey").alias("file_id"), (2000 + F.col("o_custkey")).alias("length"))
    return S.section_metrics(s.unionByName(lines), rows(spark, "file_id long, length long", *LENGTHS).unionByName(lengths))


@query(
    """WITH s AS (SELECT o_custkey AS file_id, o_orderkey AS label, epoch(o_orderdate)::BIGINT AS s, epoch(o_orderdate)::BIGINT + 86400 * 5 AS e FROM orders),
h AS (SELECT *, coalesce(lead(s) OVER w < e, false) OR coalesce(lag(e) OVER w > s, false) AS hit FROM s WINDOW w AS (PARTITION BY file_id ORDER BY s, e, label)) SELECT file_id, count(DISTINCT label) FILTER (hit) AS overlap_count FROM h GROUP BY file_id"""
)
def anm_adjacent_overlaps(spark, sf_dir):
    """ANM-4 and ANM-12 on orders as spans of five days."""
    at = F.unix_timestamp("o_orderdate")
    spans = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("label"), at.alias("s"), (at + 86_400 * 5).alias("e"))
    return S.adjacent_overlaps(spans, "file_id", "s", "e", "label")


EXTENTS = ((1, 0, 16), (1, 20, 30), (1, 28, 40), (2, 5, 10), (3, 0, 100))
WHOLES = ((1, 64), (2, 10), (3, 100))


@query(
    f"""WITH x AS (SELECT -id AS id, s, e FROM {values("id, s, e", *EXTENTS)} UNION ALL SELECT o_custkey, epoch(o_orderdate)::BIGINT // 86400, epoch(o_orderdate)::BIGINT // 86400 + 30 FROM orders),
r AS (SELECT id, s, e FROM x UNION ALL SELECT -id, size, size FROM {values("id, size", *WHOLES)} UNION ALL SELECT c_custkey, 30000, 30000 FROM customer), g AS (SELECT id, s, coalesce(max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r)
SELECT id, b AS gap_start, s - b AS gap_bytes FROM g WHERE s - b >= 1"""
)
def anm_unclaimed(spark, sf_dir):
    """ANM-6: what no extent covers, of typed files, and of the days that a customer's orders leave."""
    day = F.floor(F.unix_timestamp("o_orderdate") / 86_400)
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), day.alias("s"), (day + 30).alias("e"))
    extents = rows(spark, "id long, s long, e long", *((-i, a, b) for i, a, b in EXTENTS)).unionByName(orders)
    whole = rows(spark, "id long, size long", *((-i, n) for i, n in WHOLES)).unionByName(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lit(30_000).cast("long").alias("size")))
    return S.unclaimed(extents, "id", "s", "e", whole, "size")


@query(
    """WITH q AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 20), g AS (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i FROM q)
SELECT l_orderkey, min(l_linenumber) AS first, max(l_linenumber) AS last, count(*) AS length FROM g GROUP BY l_orderkey, i"""
)
def rel_islands(spark, sf_dir):
    """REL-W1: runs of consecutive lines of an order with more than twenty pieces."""
    lines = table(spark, sf_dir, "lineitem")
    return S.runs(lines, "l_orderkey", "l_linenumber", F.col("l_quantity") > 20)


@query("""SELECT p_brand, p_partkey, p_retailprice, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r FROM part) WHERE r <= 3""")
def rel_top_k(spark, sf_dir):
    """REL-S1: the dearest three of each brand."""
    own = W.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    return table(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_retailprice", F.row_number().over(own).alias("rank")).filter("rank <= 3")


@query("""SELECT s_nationkey, round(sum(s_acctbal * (1 + s_suppkey)) / sum(1 + s_suppkey), 6) AS weighted, round(avg(s_acctbal), 6) AS mean, round(var_pop(s_acctbal), 4) AS variance, count(DISTINCT s_name) AS names FROM supplier GROUP BY s_nationkey""")
def rel_weighted_average(spark, sf_dir):
    """REL-A2, A3 and A5."""
    s = table(spark, sf_dir, "supplier")
    return s.groupBy("s_nationkey").agg(F.round(F.sum(F.col("s_acctbal") * (1 + F.col("s_suppkey"))) / F.sum(1 + F.col("s_suppkey")), 6).alias("weighted"), F.round(F.avg("s_acctbal"), 6).alias("mean"), F.round(F.var_pop("s_acctbal"), 4).alias("variance"), F.countDistinct("s_name").alias("names"))


@query("""SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def rel_anti_join(spark, sf_dir):
    """REL-J2 and U2."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "source")


@query("""SELECT d.doc_id, toxic, quality, n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def rel_equi_join(spark, sf_dir):
    """REL-J1."""
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "toxic", "quality", "n_chars")


@query("""SELECT coalesce(n_nationkey, s_nationkey) AS nation, n_name, s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL OUTER JOIN (SELECT * FROM supplier WHERE s_nationkey >= 8) ON n_nationkey = s_nationkey""")
def rel_full_outer(spark, sf_dir):
    """REL-J5."""
    n, s = table(spark, sf_dir, "nation").filter("n_nationkey < 15"), table(spark, sf_dir, "supplier").filter("s_nationkey >= 8")
    return n.join(s, n["n_nationkey"] == s["s_nationkey"], "full_outer").select(F.coalesce("n_nationkey", "s_nationkey").alias("nation"), "n_name", "s_suppkey")


BANDS = ((0, 0.0, 1000.0), (1, 1000.0, 1300.0), (2, 1300.0, 1e9))


@query(f"SELECT p_partkey, b AS band FROM part JOIN {values('b, lo, hi', *BANDS)} ON p_retailprice >= lo AND p_retailprice < hi")
def rel_range_join(spark, sf_dir):
    """REL-J4: prices to the bands that hold them; the bands are a fixed list."""
    bands = F.broadcast(rows(spark, "band int, lo double, hi double", *BANDS))
    return table(spark, sf_dir, "part").join(bands, F.expr("p_retailprice >= lo AND p_retailprice < hi")).select("p_partkey", "band")


# records

NOW = 1_735_689_600


@query(
    f"""WITH r AS (SELECT user_id AS package, CAST(floor(epoch(ts)) AS BIGINT) AS stamp FROM events), m AS (SELECT max(stamp) AS now FROM r)
SELECT package, count(*) AS releases, count(*) FILTER (greatest(now - stamp, 0) <= 86400) AS releases_24h, count(*) FILTER (greatest(now - stamp, 0) <= 172800) AS releases_48h, (greatest(any_value(now) - min(stamp), 0) // 86400)::BIGINT AS package_age_days, (greatest(any_value(now) - max(stamp), 0) // 86400)::BIGINT AS age_days FROM r, m GROUP BY package"""
)
def jsn_release_bursts(spark, sf_dir):
    """JSN-8: events as releases, up to the latest of them."""
    r = table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), F.unix_timestamp("ts").alias("at"))
    return R.package_timeline(r, r.agg(F.max("at")).first()[0] or 0)


@query("""WITH r AS (SELECT user_id AS package, CAST(floor(epoch(ts)) AS BIGINT) AS "at", event_id FROM events) SELECT package, "at", event_id, max("at") OVER (PARTITION BY package ORDER BY "at" RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_at FROM r""")
def rel_previous_release(spark, sf_dir):
    """REL-J6."""
    return R.previous_release(table(spark, sf_dir, "events").select(F.col("user_id").alias("package"), F.unix_timestamp("ts").alias("at"), "event_id"))


@query("""SELECT event_id, strlen(props) > 14 AS skipped, CASE WHEN strlen(props) <= 14 THEN len(json_keys(props))::INTEGER END AS n_keys FROM events""")
def jsn_generic_json(spark, sf_dir):
    """JSN-2, with a limit that some rows pass."""
    x = R.generic_json(F.col("props"), 14)
    return table(spark, sf_dir, "events").select("event_id", x["skipped"].alias("skipped"), F.when(x["parsed"].isNotNull(), F.size(F.map_keys(F.from_json("props", "map<string,string>")))).alias("n_keys"))


INFO = ((1, "Metadata-Version: 2.1\nName: demo\nClassifier: A\nClassifier: B\nDescription: one\n  two\n\nBody: no\n"), (2, "name: x\r\nVersion: 1\r\n\r\nrest"), (3, ""))
_INFO_WANT = ((1, "metadata-version", "2.1"), (1, "name", "demo"), (1, "classifier", "A"), (1, "classifier", "B"), (1, "description", "one\ntwo"), (2, "name", "x"), (2, "version", "1"))


@query("SELECT * FROM " + values("id, key, value", *_INFO_WANT))
def jsn_pkg_info(spark, sf_dir):
    return rows(spark, "id long, text string", *INFO).select("id", F.explode(R.pkg_info(F.col("text"))).alias("x")).select("id", "x.key", "x.value")


MARKDOWN = ((1, "intro\n```\n# not this\n```\n## Real title ##\nsee https://github.com/a/b.git and github.com/c/d, github.com/a/b"), (2, "no heading"), (3, "# T\n~~~\nx"))


@query("SELECT id, title, repos FROM " + values("id, title, repos", (1, "Real title", ["a/b", "c/d"])) + " UNION ALL SELECT 2, NULL, [] UNION ALL SELECT 3, 'T', []")
def jsn_markdown(spark, sf_dir):
    return rows(spark, "id int, text string", *MARKDOWN).select("id", R.markdown(F.col("text")).alias("x")).select("id", "x.title", "x.repos")


@query(
    """WITH c AS (SELECT o_orderkey AS key, epoch(o_orderdate)::BIGINT AS used_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes FROM orders), m AS (SELECT max(used_at) - 86400 * 600 AS least FROM c), l AS (SELECT c.* FROM c, m WHERE used_at >= least),
r AS (SELECT *, row_number() OVER w AS rank, sum(bytes) OVER w AS total, count(*) OVER () AS n, sum(bytes) OVER () AS b FROM l WINDOW w AS (ORDER BY used_at DESC, key ROWS UNBOUNDED PRECEDING))
SELECT key, used_at, bytes FROM r WHERE NOT (n > 2000 OR b > 50000000) OR (rank <= 1800 AND total <= 45000000)"""
)
def inc_retention(spark, sf_dir):
    """INC-4 on orders as cached items."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.unix_timestamp("o_orderdate").alias("used_at"), F.floor("o_totalprice").alias("bytes"))
    now = c.agg(F.max("used_at")).first()[0] or 0
    return R.retained(c, now, 86_400 * 600, 2000, 50_000_000)


@query("""SELECT doc_id, sha256(coalesce(text, '') || '|8|base') AS cache_key, sha256(coalesce(text, '') || '|8|base')[1:2] AS shard FROM documents""")
def inc_cache_keys(spark, sf_dir):
    """INC-1 and INC-3: keys of content and variant, and their shards."""
    key = F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("|8|base")), 256)
    return table(spark, sf_dir, "documents").select("doc_id", key.alias("cache_key"), F.substring(key, 1, 2).alias("shard"))


@query("""WITH known AS (SELECT DISTINCT sha256(text) AS k FROM documents WHERE doc_id % 3 = 0) SELECT doc_id FROM documents WHERE sha256(text) NOT IN (SELECT k FROM known)""")
def inc_misses(spark, sf_dir):
    """INC-2: what must be computed, when a third of all documents is stored already."""
    from faktum.streaming.incremental import misses

    docs = table(spark, sf_dir, "documents").withColumn("key", F.sha2("text", 256))
    return misses(docs, docs.filter("doc_id % 3 = 0").select("key")).select("doc_id")


# identity

BASES = ("foo-1.2.3.tar.gz", "2020-01-15-bar_v2.zip", "2020-vision.tar.gz", "noversion.zip", "a-b-3.4rc1.tar.bz2", "x.y-1.0.whl", "plain.txt", "-1.0.zip", "lib.2.TGZ", "foo-1.0!.zip")
_NAMED = (("foo-1.2.3.tar.gz", "foo", "1.2.3"), ("2020-01-15-bar_v2.zip", "bar", "v2"), ("2020-vision.tar.gz", None, None), ("noversion.zip", None, None), ("a-b-3.4rc1.tar.bz2", "a-b", "3.4rc1"), ("x.y-1.0.whl", "x.y", "1.0"), ("plain.txt", None, None), ("-1.0.zip", "-1", "0"), ("lib.2.TGZ", "lib", "2"), ("foo-1.0!.zip", None, None))


@query("SELECT * FROM " + values("base, name, version", *_NAMED) + " UNION ALL SELECT 'part' || p_partkey || '-kit-' || p_size || '.' || p_partkey % 10 || '.tar.gz', 'part' || p_partkey || '-kit', p_size || '.' || p_partkey % 10 FROM part")
def idy_name_version(spark, sf_dir):
    """Typed names, and names of archives made of parts and their sizes."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part"), "p_partkey", F.lit("-kit-"), "p_size", F.lit("."), F.col("p_partkey") % 10, F.lit(".tar.gz")).alias("base"))
    return rows(spark, "base string", *((x,) for x in BASES)).unionByName(parts).select("base", I.name_version(F.col("base")).alias("x")).select("base", "x.name", "x.version")


PEOPLE = (("Ann Lee <ann@x.org> (https://x.org)", "Ann Lee", "ann@x.org", "https://x.org"), ("Bo", "Bo", None, None), ("<c@d>", None, "c@d", None), ("E ( u )", "E", None, "u"), ("", None, None, None))


@query("SELECT * FROM " + values("s, name, email, url", *PEOPLE) + " UNION ALL SELECT c_name || ' <c' || c_custkey || '@' || lower(c_mktsegment) || '.example> (https://' || c_nationkey || '.example)', c_name, 'c' || c_custkey || '@' || lower(c_mktsegment) || '.example', 'https://' || c_nationkey || '.example' FROM customer")
def idy_person(spark, sf_dir):
    """Typed persons, and customers with addresses."""
    who = table(spark, sf_dir, "customer").select(F.concat("c_name", F.lit(" <c"), "c_custkey", F.lit("@"), F.lower("c_mktsegment"), F.lit(".example> (https://"), "c_nationkey", F.lit(".example)")).alias("s"))
    return rows(spark, "s string", *((x[0],) for x in PEOPLE)).unionByName(who).select("s", I.person(F.col("s")).alias("x")).select("s", "x.*")


NAMES_DN = (("CN=Acme\\, Inc.,O=Acme + L=Oslo", "Acme, Inc.", "Acme", "Oslo"), ("O = Sole", None, "Sole", None), ("CN=", None, None, None))


@query("SELECT * FROM " + values("dn, cn, o, l", *NAMES_DN) + " UNION ALL SELECT 'CN=' || s_name || '\\, Ltd.,O=' || s_suppkey || ' + L=' || n_name, s_name || ', Ltd.', s_suppkey::VARCHAR, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def idy_dn_attributes(spark, sf_dir):
    """Typed names, and suppliers with their nations."""
    who = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("CN="), "s_name", F.lit("\\, Ltd.,O="), "s_suppkey", F.lit(" + L="), "n_name").alias("dn"))
    return rows(spark, "dn string", *((x[0],) for x in NAMES_DN)).unionByName(who).select("dn", *(I.dn_attribute(F.col("dn"), a).alias(a) for a in ("cn", "o", "l")))


URLS = (("git+https://github.com/Own/Repo.git#main", "pkg:github/own/repo"), ("https://gitlab.com/a/b/-/tree", "pkg:gitlab/a/b"), ("ssh://git@github.com/x/y", "pkg:github/x/y"), ("https://example.com/a/b", None))


_FORGES = ("git+https://github.com/", "https://gitlab.com/", "https://forge.example/")


@query(f"SELECT * FROM {values('url, purl', *URLS)} UNION ALL SELECT {literal(_FORGES)}[1 + o_orderkey % 3] || 'Own' || o_custkey || '/Repo' || o_orderkey || '.git', CASE o_orderkey % 3 WHEN 0 THEN 'pkg:github/own' WHEN 1 THEN 'pkg:gitlab/own' END || o_custkey || '/repo' || o_orderkey FROM orders")
def ref_forge_purl(spark, sf_dir):
    """Typed addresses, and addresses made of orders and their customers."""
    made = table(spark, sf_dir, "orders").select(F.concat(_picked(_FORGES, F.col("o_orderkey")), F.lit("Own"), "o_custkey", F.lit("/Repo"), "o_orderkey", F.lit(".git")).alias("url"))
    return rows(spark, "url string", *((x[0],) for x in URLS)).unionByName(made).select("url", I.forge_purl(F.col("url")).alias("purl"))


@query("""SELECT c_nationkey, md5(array_to_string(list_sort(list_distinct(list(lower(c_mktsegment)))), ',')) AS segments_hash, md5(array_to_string(list_sort(list_distinct(list(lower(c_name)))), ',')) AS names_hash FROM customer GROUP BY c_nationkey""")
def bin_similarity_hash(spark, sf_dir):
    """BIN-9 on names of customers."""
    g = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.collect_set("c_mktsegment").alias("a"), F.collect_set("c_name").alias("b"))
    return g.select("c_nationkey", I.similarity_hash(F.col("a")).alias("segments_hash"), I.similarity_hash(F.col("b")).alias("names_hash"))



DOS = ((0x5A21, 0x6000), (0x0021, 0), (0, 5), (0x50CF, 0xBF7D))


@query(
    f"""SELECT d, t, CASE WHEN d > 0 THEN (epoch(make_date(1980 + (d >> 9), (d >> 5) & 15, d & 31))::BIGINT + (t >> 11) * 3600 + ((t >> 5) & 63) * 60 + (t & 31) * 2)::BIGINT END AS unix, ((d::BIGINT * 10000000 + 116444736000000000) // 10000000 - 11644473600)::BIGINT AS from_filetime FROM (SELECT * FROM {values("d, t", *DOS)} UNION ALL SELECT ((year(l_shipdate) - 1980) << 9) + (month(l_shipdate) << 5) + day(l_shipdate), (CAST(l_quantity AS BIGINT) % 24 << 11) + (l_partkey % 60 << 5) + l_suppkey % 30 FROM lineitem)"""
)
def dt_conversions(spark, sf_dir):
    """Typed times, and the days of shipments with times of their numbers."""
    d, t = F.col("d"), F.col("t")
    day = (F.year("l_shipdate") - 1980) * 512 + F.month("l_shipdate") * 32 + F.dayofmonth("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(day.alias("d"), ((F.col("l_quantity").cast("long") % 24) * 2048 + (F.col("l_partkey") % 60) * 32 + F.col("l_suppkey") % 30).cast("int").alias("t"))
    return rows(spark, "d int, t int", *DOS).unionByName(lines).select("d", "t", I.dos_time(d, t).alias("unix"), I.filetime(d.cast("long") * 10_000_000 + 116_444_736_000_000_000).alias("from_filetime"))
