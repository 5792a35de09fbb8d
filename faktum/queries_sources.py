"""Queries of containers, binaries, sources, comments, references and whole facts, over files made in place."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib

from pyspark.sql import functions as F

from faktum.operators import comments as C
from faktum.operators import references as R
from faktum.queries_files import member_metrics_sql
from faktum.queries_text import long_metrics_sql
from faktum.registry import dealt, query, rows, spread, table, values

CODE = (
    ("c1", "c", 'int a; // TODO one\nchar *s = "// no /* no */"; /* two\nlines */ int b; // see https://x.org\n//\n/* open'),
    ("js", "javascript", "const u = `// no`; // const a = function(x) { return 1 }\nimport x from './a.js'; require('../b'); import('./a.js')"),
    ("py", "python", 'x = "# no"  # FIXME\n"""doc\nstring"""\n# QWxhZGRpbjpvcGVuIHNlc2FtZQ QWxhZGRpbjpvcGVu'),
    ("lua", "lua", "a = '-- no' -- HACK\nb = 1 -- XXX"), ("clj", "clojure", '(def a "; no") ; note'), ("bat", "batch", "@echo off\nREM first\n:: second\nremark no"), ("txt", "text", "// none"),
    ("go", "go", "// aB3$kL9#mN2@pQ7!xZ5%wV8^\n// \t\n// ftp://h/x todo Hack\n// if (a) return b\n// if (a)\ncode()\ncode()\n"),
)
_BODIES = (
    ("c1", 0, " TODO one"), ("c1", 1, " two\nlines "), ("c1", 2, " see https://x.org"), ("c1", 3, ""), ("c1", 4, " ope"), ("js", 0, " const a = function(x) { return 1 }"), ("py", 0, " FIXME"), ("py", 1, "doc\nstring"), ("py", 2, " QWxhZGRpbjpvcGVuIHNlc2FtZQ QWxhZGRpbjpvcGVu"),
    ("lua", 0, " HACK"), ("lua", 1, " XXX"), ("clj", 0, " note"), ("bat", 0, "first"), ("bat", 1, " second"),
    ("go", 0, " aB3$kL9#mN2@pQ7!xZ5%wV8^"), ("go", 1, " \t"), ("go", 2, " ftp://h/x todo Hack"), ("go", 3, " if (a) return b"), ("go", 4, " if (a)"),
)
_COUNT_LINES = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE len(string_split(regexp_replace({x}, '\\n$', ''), chr(10))) END)"
_CMT_METRICS = f"""
WITH b AS (SELECT file_id, ord, body, trim(body, chr(9) || chr(10) || chr(13) || ' ') AS bare FROM {values("file_id, ord, body", *_BODIES)}),
e AS (SELECT file_id, ord, -sum((k / n) * log2(k / n)) AS e FROM (SELECT file_id, ord, n, x, count(*) AS k FROM (SELECT file_id, ord, strlen(bare) AS n, unnest(regexp_extract_all(hex(encode(bare)), '..')) AS x FROM b) GROUP BY ALL) GROUP BY ALL),
t AS (SELECT b.file_id, body, bare, bare <> '' AS filled, coalesce(e, 0) AS e, lower(bare) AS low FROM b LEFT JOIN e ON b.file_id = e.file_id AND b.ord = e.ord),
m AS (SELECT file_id, count(*) AS total, sum({_COUNT_LINES('body')})::BIGINT AS lines, sum(strlen(body))::BIGINT AS chars, count(*) FILTER (contains(low, 'todo')) AS todo_count, count(*) FILTER (contains(low, 'fixme')) AS fixme_count,
  count(*) FILTER (contains(low, 'hack')) AS hack_count, count(*) FILTER (contains(low, 'xxx')) AS xxx_count, count(*) FILTER (NOT filled) AS empty_comments, count(*) FILTER (e > 4.5 AND strlen(bare) > 20) AS high_entropy_comments,
  count(*) FILTER (len(list_filter(['function(', 'def ', 'class ', 'if (', 'for (', 'while (', 'return ', 'import ', 'require(', 'var ', 'let ', 'const ', 'eval(', 'exec(', '= function', '=> {{'], lambda p: contains(low, p))) >= 2) AS code_in_comments,
  count(*) FILTER (regexp_matches(bare, '(http|https|ftp)://')) AS url_in_comments,
  count(*) FILTER (len(list_filter(regexp_split_to_array(bare, '\\s+'), lambda w: strlen(w) >= 20 AND length(regexp_replace(w, '[^A-Za-z0-9+/=]', '', 'g')) * 10 > strlen(w) * 9 AND regexp_matches(w, '[A-Z]') AND regexp_matches(w, '[a-z]'))) > 0) AS base64_in_comments FROM t GROUP BY file_id)
SELECT m.*, round(CASE WHEN n > lines THEN lines / (n - lines) END, 6) AS to_code_ratio FROM m JOIN (SELECT file_id, {_COUNT_LINES('text')} AS n FROM {values("file_id, file_type, text", *CODE)}) c ON m.file_id = c.file_id
"""

def _code(spark):
    return rows(spark, "file_id string, file_type string, text string", *CODE)


@query("SELECT * FROM " + values("file_id, ord, body", *_BODIES))
def cmt_bodies(spark, sf_dir):
    return C.comments(_code(spark))


@query(_CMT_METRICS)
def cmt_metrics(spark, sf_dir):
    return C.metrics(C.comments(_code(spark)), _code(spark))


@query(
    """WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) AS body FROM pages) SELECT page_id, count(*) AS total, sum(strlen(body))::BIGINT AS chars, count(*) FILTER (regexp_matches(body, '^[ \\t]*$')) AS empty FROM c GROUP BY page_id"""
)
def cmt_markup(spark, sf_dir):
    """Comments of markup, over the pages."""
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<!--(.*?)-->"), F.lit(1))).alias("body"))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("total"), F.sum(F.octet_length("body")).alias("chars"), F.count_if(F.col("body").rlike(r"\A[ \t]*\z")).alias("empty"))


MANIFESTS = (
    ("pkg", "package.json", '{"main": "index.js", "repository": {"url": "git+https://github.com/O/R.git"}, "dependencies": {"a": "1.2.3", "@s/b": "^2"}, "optionalDependencies": {"c": "0.0.1-rc.1"}}'),
    ("pkg2", "package.json", '{"main": "./index.js", "module": "./m.mjs", "exports": {".": {"require": "./index.js", "import": "./m.mjs"}, "./sub": ["./s.js", "other"], "./*": "./*.js"}, "bin": {"a": "bin/cli.js", "b": "bin/dev.js"}}'),
    ("pkg3", "package.json", '{"exports": "./only.js", "bin": "cli.js"}'), ("req", "requirements.txt", "A_b==1.0  # pin\nc>=2\nd[x]==3.* \ne == 4.0 --hash=sha256:" + "a" * 64 + "\n"), ("mod", "go.mod", "module m\ngo 1.20\nrequire (\n\tgithub.com/a/b v1.2.3 // indirect\n)\nrequire x.org/y v0.1.0\nreplace z.org/q => ./q\n"),
    ("sum", "go.sum", "github.com/a/b v1.2.3 h1:abc=\ngithub.com/a/b v1.2.3/go.mod h1:def=\n"), ("yarn", "yarn.lock", '# yarn lockfile v1\n\n\n"@s/b@^2", "@s/b@2.x":\n  version "2.1.0"\n  integrity sha512-xyz\n\nlodash@4:\n  version "4.17.21"\n'),
    ("cargo", "cargo.lock", 'version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\nchecksum = "beef"\n\n[[package]]\nname = "own"\nversion = "0.1.0"\n'), ("gem", "gemfile.lock", "GEM\n  remote: x\n  specs:\n    rake (13.0)\n      dep (>= 1)\n    rack (2.2.3)\n\nPLATFORMS\n  ruby\n"),
    ("gha", "github_actions", "on: push\njobs:\n  a:\n    steps:\n      - uses: actions/checkout@v4\n      - uses: ./local\n      - uses: o/r/sub@abc # pin\n"), ("js", "javascript", "import x from './a.js'; require('../b'); import('./a.js'); import 'pkg'"),
    ("src", "src_info", "pkgbase = x\n\tsource = n::https://x.org/a.tgz\n\tsource = local.patch\n\tsha256sums = abc\n\tsha256sums = SKIP\n\tdepends = glibc>=2\n"),
)
_REFERENCES = (
    ("pkg", 0, "purl", "pkg:npm/a@1.2.3", "dependency", None), ("pkg", 1, "purl", "pkg:npm/%40s/b", "dependency", None), ("pkg", 2, "purl", "pkg:npm/c@0.0.1-rc.1", "dependency", None), ("pkg", 3, "path", "index.js", "local", None), ("pkg", 4, "purl", "pkg:github/o/r", "repository", None),
    ("pkg2", 0, "path", "./index.js", "local", None), ("pkg2", 1, "path", "./m.mjs", "local", None), ("pkg2", 2, "path", "./s.js", "local", None), ("pkg2", 3, "path", "bin/cli.js", "local", None), ("pkg2", 4, "path", "bin/dev.js", "local", None), ("pkg3", 0, "path", "./only.js", "local", None), ("pkg3", 1, "path", "cli.js", "local", None),
    ("req", 0, "purl", "pkg:pypi/a-b@1.0", "dependency", None), ("req", 1, "purl", "pkg:pypi/e@4.0", "dependency", "a" * 64), ("mod", 0, "purl", "pkg:golang/github.com/a/b@v1.2.3", "dependency", None), ("mod", 1, "purl", "pkg:golang/x.org/y@v0.1.0", "dependency", None), ("sum", 0, "purl", "pkg:golang/github.com/a/b@v1.2.3", "dependency", "abc="),
    ("yarn", 0, "purl", "pkg:npm/%40s/b@2.1.0", "dependency", "sha512-xyz"), ("yarn", 1, "purl", "pkg:npm/lodash@4.17.21", "dependency", None), ("cargo", 0, "purl", "pkg:cargo/serde@1.0.1", "dependency", "beef"), ("cargo", 1, "purl", "pkg:cargo/own@0.1.0", "dependency", None), ("gem", 0, "purl", "pkg:gem/rake@13.0", "dependency", None), ("gem", 1, "purl", "pkg:gem/rack@2.2.3", "dependency", None),
    ("gha", 0, "purl", "pkg:github/actions/checkout@v4", "dependency", None), ("gha", 1, "purl", "pkg:github/o/r@abc", "dependency", None), ("gha", 2, "path", "./local", "local", None), ("js", 0, "path", "./a.js", "local", None), ("js", 1, "path", "../b", "local", None), ("src", 0, "url", "https://x.org/a.tgz", "url_fetch", "abc"), ("src", 1, "purl", "pkg:alpm/arch/glibc", "dependency", None),
)


@query("SELECT * FROM " + values("file_id, ord, locator_type, locator, kind, pin", *_REFERENCES))
def ref_references(spark, sf_dir):
    return R.references(rows(spark, "file_id string, file_type string, text string", *MANIFESTS)).drop("source")


def sample_zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("d/", (2020, 1, 2, 3, 4, 6)), "")
        z.writestr(zipfile.ZipInfo("d/a.txt", (2020, 1, 2, 3, 4, 6)), "hello " * 20, zipfile.ZIP_DEFLATED)
        z.writestr(zipfile.ZipInfo("d/report.pdf.exe", (1980, 1, 1, 0, 0, 0)), "x")
    return out.getvalue()


def sample_tar(prefix: str = "t/", packed: bool = False, names=("a", "b")) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w:gz" if packed else "w") as t:
        for k, name in enumerate(names):
            i = tarfile.TarInfo(prefix + name)
            i.size, i.mode, i.mtime, i.uname = 3, 0o4755 if k else 0o644, 1_600_000_000, "u"
            t.addfile(i, io.BytesIO(b"abc"))
        i = tarfile.TarInfo(prefix + "link")
        i.type, i.linkname = tarfile.SYMTYPE, "../../etc/passwd"
        if not packed:
            t.addfile(i)
    return out.getvalue()


def sample_ar() -> bytes:
    member = lambda name, data: f"{name:<16}{'1600000000':<12}{'0':<6}{'0':<6}{'100644':<8}{len(data):<10}`\n".encode() + data + b"\n" * (len(data) % 2)
    return b"!<arch>\n" + member("debian-binary", b"2.0\n") + member("data.tar", b"xyz")


def sample_elf() -> bytes:
    names = b"\0.text\0.data\0.shstrtab\0"
    head = struct.pack("<4sBBBBB7xHHIQQQIHHHHHH", b"\x7fELF", 2, 1, 1, 0, 0, 2, 62, 1, 0x1010, 64, 0, 0, 64, 56, 2, 64, 4, 3)
    load = lambda flags, off, va, size: struct.pack("<IIQQQQQQ", 1, flags, off, va, va, size, size, 4096)
    body = bytes(range(64)) + bytes(32) + names
    at = 64 + 112
    table_at = at + len(body)
    section = lambda name, kind, flags, off, size: struct.pack("<IIQQQQIIQQ", name, kind, flags, 0x1000 + off - at, off, size, 0, 0, 1, 0)
    tables = bytes(64) + section(1, 1, 6, at, 64) + section(7, 1, 3, at + 64, 32) + section(13, 3, 0, at + 96, len(names))
    head = head[:40] + struct.pack("<Q", table_at) + head[48:]
    return head + load(5, 0, 0x1000, 0x100) + load(7, 0x100, 0x2000, 0x40) + body + tables


def sample_png() -> bytes:
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(20))) + chunk(b"IEND", b"") + b"tail"


def sample_class() -> bytes:
    text = lambda s: b"\1" + struct.pack(">H", len(s)) + s
    pool = text(b"Main") + b"\7\0\1" + text(b"run") + text(b"()V")
    return b"\xca\xfe\xba\xbe" + struct.pack(">HHH", 0, 52, 5) + pool + struct.pack(">HHHH", 1, 2, 0, 0) + struct.pack(">H", 0) + struct.pack(">HHHHH", 1, 9, 3, 4, 0) + struct.pack(">H", 0)


def _archives(spark):
    return rows(spark, "file_id string, archive_format string, content binary", ("z", "zip", sample_zip()), ("t", "tar", sample_tar()), ("a", "ar", sample_ar()), ("bad", "zip", b"PK\3\4 cut"), ("none", "rar", b"Rar!"))


_MEMBERS = (
    ("a", 0, "debian-binary", 4, 4, "file", "stored", 0o100644 & 0o7777, 1_600_000_000, None, False, 0, 0, None, None, None, 8, None), ("a", 1, "data.tar", 3, 3, "file", "stored", 0o644, 1_600_000_000, None, False, 0, 0, None, None, None, 72, None),
    ("bad", -1, *[None] * 15, "zip-parse: File is not a zip file"), ("t", 0, "t/a", 3, 3, "file", "stored", 0o644, 1_600_000_000, None, False, 0, 0, None, "u", None, 0, None), ("t", 1, "t/b", 3, 3, "file", "stored", 0o4755, 1_600_000_000, None, False, 0, 0, None, "u", None, 1024, None),
    ("t", 2, "t/link", 0, 0, "symlink", "stored", 0o644, None, None, False, 0, 0, "../../etc/passwd", None, None, 2048, None), ("z", 0, "d/", 0, 0, "directory", "stored", 0o600, 1_577_934_246, 0, False, 0, 0, None, None, None, 0, None),
    ("z", 1, "d/a.txt", 120, 11, "file", "deflate", 0o600, 1_577_934_246, zlib.crc32(b"hello " * 20), False, 0, 0, None, None, None, 32, None), ("z", 2, "d/report.pdf.exe", 1, 1, "file", "stored", 0o600, None, 0x8CDC1683, False, 0, 0, None, None, None, 80, None),
)


@query("SELECT * FROM " + values('file_id, ord, path, size_bytes, compressed_bytes, entry_type, method, mode, mtime_unix, crc32, encrypted, extra_bytes, comment_bytes, linkname, uname, gname, "offset", error', *_MEMBERS))
def arc_members(spark, sf_dir):
    """Members of a ZIP, a tar and an ar archive, and the error of one that is cut off."""
    from faktum.sources.containers import members

    return members(_archives(spark))


_FOUND = "(SELECT * FROM " + values("file_id, path, size_bytes, compressed_bytes, entry_type, mode, mtime_unix, crc32, encrypted, extra_bytes, comment_bytes", *((m[0], *m[2:6], *m[7:13]) for m in _MEMBERS)) + " WHERE path IS NOT NULL)"


@query(member_metrics_sql(_FOUND))
def arc_metrics_of_files(spark, sf_dir):
    """From bytes to the aggregates, in one plan."""
    from faktum.operators.archive import member_metrics
    from faktum.sources.containers import members

    return member_metrics(members(_archives(spark)).filter("error IS NULL"))


@query("SELECT * FROM " + values("path, file_type, source, extension_type, extension_mismatch", ("x.tgz", "npm", "magic", "tar.gz", False), ("y.tar.gz", "python_sdist", "magic", "tar.gz", False), ("z.tar.gz", "tar.gz", "magic", None, False), ("i.tar", "oci_image", "magic", "tar", False), ("t.tar", "tar", "extension", None, False)))
def id_peeked(spark, sf_dir):
    """Packages known by what lies inside their compressed stream."""
    from faktum.operators.identify import identify
    from faktum.sources.containers import peek

    files = (("x.tgz", sample_tar("package/", True, ("package.json", "index.js"))), ("y.tar.gz", sample_tar("y-1/", True, ("PKG-INFO", "setup.py"))), ("z.tar.gz", sample_tar("z/", True)), ("i.tar", sample_tar("", False, ("oci-layout", "index.json"))), ("t.tar", sample_tar()))
    own = rows(spark, "path string, content binary", *files).withColumn("forced_type", F.lit(None).cast("string"))
    return identify(own, peek(F.col("path"), F.col("content"))).drop("content", "forced_type")


_METRICS = (
    ("class", "class.constant_pool_size", 4), ("class", "class.interface_count", 0), ("class", "class.major_version", 52), ("elf", "elf.entry", 0x1010), ("elf", "elf.entry_in_last_segment", 0), ("elf", "elf.entry_in_writable_segment", 0), ("elf", "elf.entry_outside_segments", 0), ("elf", "elf.machine", 62),
    ("elf", "elf.nx_enabled", 1), ("elf", "elf.type", 2), ("elf", "elf.wx_segment_count", 1), ("pkl", "pickle.op.appends", 1), ("pkl", "pickle.op.binput", 3), ("pkl", "pickle.op.binunicode", 1), ("pkl", "pickle.op.empty_list", 1), ("pkl", "pickle.op.global", 1), ("pkl", "pickle.op.mark", 1), ("pkl", "pickle.op.proto", 1), ("pkl", "pickle.op.stop", 1),
    ("png", "png.bit_depth", 8), ("png", "png.color_type", 2), ("png", "png.height", 2), ("png", "png.trailing_bytes", 4), ("png", "png.width", 3), ("pyc", "pyc.flags", 0), ("pyc", "pyc.magic", 3531), ("pyc", "pyc.mtime", 1_600_000_000), ("pyc", "pyc.source_size", 7),
)
_PLACES = (
    ("bad", "error", None, "pe-parse", None, None, None, None, None, None), ("class", "function", 0, "run", None, None, None, None, None, 9.0), ("class", "reference", 0, "Main", None, None, None, None, None, None),
    ("elf", "section", 0, ".text", 176, 64, 4096, ["alloc", "executable"], 6.0, None), ("elf", "section", 1, ".data", 240, 32, 4160, ["writable", "alloc"], 0.0, None), ("elf", "section", 2, ".shstrtab", 272, 23, 4192, [], 3.170544, None), ("elf", "segment", 0, "1", 0, 256, 4096, ["read", "executable"], None, 256.0), ("elf", "segment", 1, "1", 256, 64, 8192, ["read", "writable", "executable"], None, 64.0),
    ("pkl", "import", 6, "__builtin__.len", None, None, None, None, None, None), ("png", "chunk", 0, "IHDR", 16, 13, None, [], 1.35203, None), ("png", "chunk", 2, "IEND", 64, 0, None, [], None, None), ("wasm", "export", 0, "e", None, None, None, [], None, None), ("wasm", "import", 0, "f", None, None, None, ["m"], None, None),
    ("wasm", "section", 0, "import", 10, 7, None, None, 1.842371, None), ("wasm", "section", 1, "export", 19, 5, None, None, 1.521928, None),
)


@query(
    "SELECT * FROM " + values("file_id, view, ord, name, start, size, address, flags, entropy, value", *_PLACES) + f" UNION ALL SELECT file_id, 'metric', NULL, name, NULL, NULL, NULL, NULL, NULL, CAST(value AS DOUBLE) FROM {values('file_id, name, value', *_METRICS)}"
)
def bin_facts(spark, sf_dir):
    """Sections, segments, chunks and header metrics; of the packed chunk, whose bytes are the compressor's own, nothing."""
    import pickle

    from faktum.sources.binaries import facts

    wasm = b"\0asm\1\0\0\0" + b"\2\7\1\1m\1f\0\0" + b"\7\5\1\1e\0\0"
    files = (("elf", "elf", sample_elf()), ("png", "png", sample_png()), ("class", "java_class", sample_class()), ("wasm", "wasm", wasm), ("pkl", "pickle", pickle.dumps([len, "x"], 2)), ("pyc", "python_bytecode", b"\xcb\r\r\n" + struct.pack("<III", 0, 1_600_000_000, 7)), ("bad", "pe", b"MZ"), ("text", "text", b"x"))
    own = facts(rows(spark, "file_id string, file_type string, content binary", *files)).filter("name <> 'IDAT'")
    return own.withColumn("name", F.when(F.col("view") == "error", F.substring_index("name", ":", 1)).otherwise(F.col("name"))).withColumn("entropy", F.round("entropy", 6))


PYTHON = (
    ("a", "import os, sys as s\nfrom . import x\nfrom .y import z\n\ndef f(a, b=1):\n    return a\n\ndef g():\n    return 'lit'\n\nclass K:\n    def m(self):\n        while True:\n            os.path.join('p', a.b['c'])\n            if a == a: break\nv = w = f(1) ^ 2\n"),
    ("b", "def broken(:"),
    ("c", ""),
)


_FUNCTIONS = PYTHON + (
    ("d", "import importlib.util\nfrom os.path import *\nimport numpy as np\nimport requests\nfrom .. import q as r\n"),
    ("e", "def outer(a, bb):\n    def inner1(c):\n        return c\n    g = lambda: 0\n    return inner1\n\ndef abcdefghijklmnop(p1, p2, p3, p4, p5, p6, p7, p8): pass\n"),
    ("f", "def long():\n" + "    pass\n" * 100 + "def item12(): pass\ndef _7(): pass\n"),
)
#: (file_id, name, alias, whether the language's own library has it)
_IMPORTED = (("a", "os", None, True), ("a", "sys", "s", True), ("a", ".x", None, False), ("a", ".y.z", None, False), ("d", "importlib.util", None, True), ("d", "os.path.*", None, True), ("d", "numpy", "np", False), ("d", "requests", None, False), ("d", "..q", "r", False))
#: (file_id, name, first line, last line, functions around it, parameters, whether it holds another)
_DEFINED = (
    ("a", "f", 5, 6, 0, "a b", False), ("a", "g", 8, 9, 0, "", False), ("a", "m", 12, 15, 0, "self", False), ("e", "outer", 1, 5, 0, "a bb", True), ("e", "inner1", 2, 3, 1, "c", False), ("e", None, 4, 4, 1, "", False), ("e", "abcdefghijklmnop", 7, 7, 0, "p1 p2 p3 p4 p5 p6 p7 p8", False), ("f", "long", 1, 101, 0, "", False), ("f", "item12", 102, 102, 0, "", False), ("f", "_7", 103, 103, 0, "", False),
)
#: Orders as Python sources, a statement or function for each line: what they import and define follows from their rows.
_ORDER_IMPORTS = """SELECT 'o' || o_orderkey AS file_id, unnest(['os', 'mod' || o_custkey, '.pkg.x' || o_orderstatus]) AS name, unnest([NULL, 'm', NULL]) AS alias, unnest([true, false, false]) AS known FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'o' || l_orderkey, 'numpy', NULL, false FROM lineitem WHERE l_returnflag NOT IN ('R', 'A') AND l_orderkey IN (SELECT o_orderkey FROM orders)"""
_ORDER_FUNCTIONS = """SELECT 'o' || l_orderkey AS file_id, CASE l_returnflag WHEN 'R' THEN 'r' || l_partkey % 100 ELSE 'wide_name_' || l_suppkey END AS name, 1 AS a, CASE l_returnflag WHEN 'R' THEN 2 ELSE 1 END AS b, 0 AS depth,
  CASE l_returnflag WHEN 'R' THEN 'a qty' ELSE 'p1 p2 p3 p4 p5 p6 p7 p8' END AS p, false AS holds FROM lineitem WHERE l_returnflag IN ('R', 'A') AND l_orderkey IN (SELECT o_orderkey FROM orders)"""
_ORDER_TEXTS = "SELECT 'o' || l_orderkey AS file_id, repeat('x' || chr(10), 3 + count(*) + count(*) FILTER (l_returnflag = 'R')) AS text FROM lineitem GROUP BY l_orderkey"


def _sources(spark, sf_dir):
    """Typed sources, and those made of orders."""
    key = F.col("l_partkey") % 100
    statement = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("def r"), key, F.lit("(a, qty):\n    return a\n"))).when(F.col("l_returnflag") == "A", F.concat(F.lit("def wide_name_"), "l_suppkey", F.lit("(p1, p2, p3, p4, p5, p6, p7, p8): pass\n"))).otherwise("import numpy\n")
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines, orders = dealt(lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"), "l_orderkey", of=(orders,)), dealt(orders, "o_orderkey", of=(lines,))
    made = lines.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", statement.alias("s")).alias("x")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    orders = orders.join(made, F.col("o_orderkey") == F.col("l_orderkey"))
    text = F.concat(F.lit("import os\nimport mod"), "o_custkey", F.lit(" as m\nfrom .pkg import x"), "o_orderstatus", F.lit("\n"), F.array_join("x.s", ""))
    return rows(spark, "file_id string, text string", *_FUNCTIONS).unionByName(orders.select(F.concat(F.lit("o"), "o_orderkey").alias("file_id"), text.alias("text")))


_IMP_METRICS = f"""SELECT file_id, count(DISTINCT name) AS unique_modules, count(*) FILTER (known) AS stdlib_count, count(*) FILTER (NOT known AND name NOT LIKE '.%') AS third_party_count, count(*) FILTER (name LIKE '.%') AS relative_imports,
  count(*) FILTER (regexp_matches(name, '__import__|importlib|require')) AS dynamic_imports, count(*) FILTER (contains(name, '*')) AS wildcard_imports, count(alias) AS aliased_imports,
  round(count(*) FILTER (known) / count(*), 6) AS stdlib_ratio, round(count(*) FILTER (NOT known AND name NOT LIKE '.%') / count(*), 6) AS third_party_ratio, round(count(*) FILTER (name LIKE '.%') / count(*), 6) AS relative_ratio FROM (SELECT * FROM {values("file_id, name, alias, known", *_IMPORTED)} UNION ALL {_ORDER_IMPORTS}) GROUP BY file_id"""
_FUN_METRICS = f"""
WITH f AS (SELECT *, b - a + 1 AS size, CASE WHEN p = '' THEN [] ELSE string_split(p, ' ') END AS params FROM (SELECT * FROM {values("file_id, name, a, b, depth, p, holds", *_DEFINED)} UNION ALL {_ORDER_FUNCTIONS})),
e AS (SELECT name, -sum((k / n) * log2(k / n)) AS e FROM (SELECT name, strlen(name) AS n, c, count(*) AS k FROM (SELECT DISTINCT name, unnest(range(1, strlen(name) + 1)) AS i, name[i] AS c FROM f WHERE name IS NOT NULL) GROUP BY ALL) GROUP BY name),
n AS (SELECT file_id, {_COUNT_LINES('text')} AS n FROM (SELECT * FROM {values("file_id, text", *_FUNCTIONS)} UNION ALL {_ORDER_TEXTS}))
SELECT f.file_id, count(*) AS count, count(*) FILTER (f.name IS NULL) AS anonymous, count(*) FILTER (holds) AS nested_functions, count(*) FILTER (size > 100) AS over_100_lines, count(*) FILTER (size > 500) AS over_500_lines, count(*) FILTER (size <= 1) AS one_liners,
  count(*) FILTER (p = '') AS no_params_count, count(*) FILTER (len(params) > 7) AS many_params_count, count(*) FILTER (strlen(f.name) = 1) AS single_char_names, count(*) FILTER (e > 3.5) AS high_entropy_names, count(*) FILTER (regexp_matches(f.name, '[A-Za-z][0-9]$')) AS numeric_suffix_names,
  round(avg(size), 6) AS avg_length_lines, max(size)::BIGINT AS max_length_lines, min(size)::BIGINT AS min_length_lines, round(stddev_pop(size), 6) AS length_stddev, round(avg(len(params)), 6) AS avg_params, max(len(params))::INTEGER AS max_params,
  round(sum(strlen(replace(p, ' ', ''))) / nullif(sum(len(params)), 0), 6) AS avg_param_name_length, sum(len(list_filter(params, lambda x: strlen(x) = 1)))::BIGINT AS single_char_params, round(avg(strlen(f.name)), 6) AS avg_name_length,
  max(depth)::BIGINT AS max_nesting_depth, round(avg(depth), 6) AS avg_nesting_depth, round(100 * count(*) / any_value(n), 6) AS density_per_100_lines, round(sum(size) / any_value(n), 6) AS code_in_functions_ratio
FROM f JOIN n ON f.file_id = n.file_id LEFT JOIN e ON f.name = e.name GROUP BY f.file_id
"""


@query()
def src_python_symbols(spark, sf_dir):
    """Imports, functions, calls, binds, members, literals and tree metrics of Python."""
    from faktum.sources.python_source import symbols

    return symbols(rows(spark, "file_id string, text string", *PYTHON))


@query(_IMP_METRICS)
def imp_metrics(spark, sf_dir):
    """Import metrics over the symbols of Python sources, typed ones and orders."""
    from faktum.operators.imports import import_metrics
    from faktum.sources.python_source import stdlib, symbols

    found = symbols(_sources(spark, sf_dir), ("import",)).select("file_id", "name", "alias")
    return import_metrics(found, stdlib())


@query(_FUN_METRICS)
def fun_metrics(spark, sf_dir):
    """Function metrics over the symbols of Python sources, typed ones and orders."""
    from faktum.operators.imports import function_metrics
    from faktum.sources.python_source import symbols

    sources = _sources(spark, sf_dir)
    return function_metrics(symbols(sources, ("function",)), sources)


PDFS = (
    ("p1", b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /OpenAction 2 0 R /AcroForm << >> >>\nendobj\n2 0 obj << /S /JavaScript /JS (app.alert) >> endobj\nstream\nx\nendstream\ntrailer\nstartxref\n0\n%%EOF\n%%EOF"),
    ("p2", b"%PDF-1.7\n1 0 obj << /Filter /FlateDecode /EmbeddedFile >> endobj\n%%EOF"),
)
_PDF_WANT = (("p1", 1, 2, 1, 2, 0, 1, ["openaction", "acroform"], 1), ("p2", 1, 1, 0, 1, 1, 0, [], 0))


@query("SELECT * FROM " + values("file_id, header_count, eof_count, startxref_count, object_count, flate_count, stream_count, features, javascript_count", *_PDF_WANT[:1]) + " UNION ALL SELECT 'p2', 1, 1, 0, 1, 1, 0, [], 0")
def doc_pdf_counts(spark, sf_dir):
    from faktum.functions.documents import pdf_counts

    own = pdf_counts(F.col("content"))
    return rows(spark, "file_id string, content binary", *PDFS).select("file_id", *(v.alias(k) for k, v in own.items()))


RTFS = (("r1", r"{\rtf1{\info{\title A title}{\author Me}}{\field{\*\fldinst HYPERLINK x}}{\object\objdata 00}}", "A title", "Me", 1, 1), ("r2", r"{\rtf1 plain}", None, None, 0, 0))


@query("SELECT file_id, title, author, field_count, object_count FROM " + values("file_id, text, title, author, field_count, object_count", *RTFS))
def doc_rtf(spark, sf_dir):
    from faktum.functions.documents import rtf_facts

    own = rtf_facts(F.col("text"))
    return rows(spark, "file_id string, text string", *(x[:2] for x in RTFS)).select("file_id", *(v.alias(k) for k, v in own.items()))


@query(long_metrics_sql("SELECT 2 * doc_id AS id, text FROM documents UNION ALL SELECT 2 * page_id + 1, html FROM pages"))
def facts_long_metrics(spark, sf_dir):
    """The wide extraction over documents and pages as files, as the long table of metrics, spans by their number and the first."""
    from faktum.plans.facts import metrics
    from faktum.sources.files import from_documents, from_pages

    long = metrics(from_documents(spread(table(spark, sf_dir, "documents"))).unionByName(from_pages(spread(table(spark, sf_dir, "pages")))))
    return long.select("file_id", "key", F.round("value", 6).alias("value"), F.size("spans").alias("n_spans"), F.try_element_at("spans", F.lit(1))["offset"].alias("first_offset"))


@query("SELECT * FROM " + values("file_id, kind, stage, message", ("bad", "malformed", "zip-parse", "zip-parse: File is not a zip file")))
def facts_errors(spark, sf_dir):
    """The dead-letter view: what could not be read, by stage."""
    from faktum.sources.containers import members

    bad = members(_archives(spark)).filter("error IS NOT NULL")
    return bad.select("file_id", F.lit("malformed").alias("kind"), F.substring_index("error", ":", 1).alias("stage"), F.col("error").alias("message"))


def _package(kind: str) -> bytes:
    out = io.BytesIO()
    if kind == "npm":
        with tarfile.open(fileobj=out, mode="w:gz") as t:
            body = b'{"name": "demo", "version": "1.0.0", "author": {"name": "A", "email": "a@b"}, "scripts": {"postinstall": "x", "test": "y"}}'
            i = tarfile.TarInfo("package/package.json")
            i.size = len(body)
            t.addfile(i, io.BytesIO(body))
    else:
        files = {
            "whl": {"demo-1.0.dist-info/METADATA": "Metadata-Version: 2.1\nName: demo\nVersion: 1.0\nAuthor: Bo\n\nbody"}, "jar": {"META-INF/MANIFEST.MF": "Manifest-Version: 1.0\r\nImplementation-Title: de\r\n mo\r\n"},
            "nupkg": {"demo.nuspec": "<package xmlns='x'><metadata><id>Demo</id><version>2</version><authors>C</authors></metadata></package>"},
            "ooxml": {"[Content_Types].xml": "<a/>", "docProps/core.xml": "<c xmlns:d='u'><d:creator>D</d:creator></c>", "word/_rels/x.rels": '<r TargetMode="External"/>', "word/vbaProject.bin": "m"},
        }[kind]
        with zipfile.ZipFile(out, "w") as z:
            for name, text in files.items():
                z.writestr(name, text)
    return out.getvalue()


def _packages(spark):
    kinds = ("npm", "whl", "jar", "nupkg", "ooxml")
    manifest = b"<PackageManifest><Metadata><Identity Id='v' Version='3' Publisher='P'/></Metadata><Assets><Asset Type='T'/></Assets></PackageManifest>"
    return rows(spark, "file_id string, file_type string, content binary", *((k, k, _package(k)) for k in kinds), ("vsix", "vsix_manifest", manifest), ("bad", "gem", b"x"))


_FACTS = (
    ("bad", 0, "error", "gem-parse: ReadError truncated header"), ("jar", 0, "manifest-version", "1.0"), ("jar", 1, "implementation-title", "demo"), ("npm", 0, "name", "demo"), ("npm", 1, "version", "1.0.0"), ("npm", 2, "author", "A <a@b>"), ("npm", 3, "script.postinstall", "x"),
    ("nupkg", 0, "id", "Demo"), ("nupkg", 1, "version", "2"), ("nupkg", 2, "authors", "C"), ("ooxml", 0, "creator", "D"), ("ooxml", 1, "macro_count", "1"), ("ooxml", 2, "embedded_count", "0"), ("ooxml", 3, "control_count", "0"), ("ooxml", 4, "external_relationship_count", "1"),
    ("vsix", 0, "identity.id", "v"), ("vsix", 1, "identity.publisher", "P"), ("vsix", 2, "identity.version", "3"), ("vsix", 3, "asset", "T"), ("whl", 0, "metadata-version", "2.1"), ("whl", 1, "name", "demo"), ("whl", 2, "version", "1.0"), ("whl", 3, "author", "Bo"),
)
_CLAIMS = (
    ("bad", None, None, None, None, None, None, False), ("jar", "demo", None, None, None, None, "implementation-title", False), ("npm", "demo", "1.0.0", "A <a@b>", None, None, "name", False), ("nupkg", "Demo", "2", "C", None, None, "id", False),
    ("ooxml", None, None, "D", None, None, None, False), ("vsix", "v", "3", "P", None, None, "identity.id", False), ("whl", "demo", "1.0", "Bo", None, None, "name", False),
)


@query("SELECT * FROM " + values("file_id, ord, key, value", *_FACTS))
def pkg_facts(spark, sf_dir):
    """Manifest facts of packages."""
    from faktum.sources.packages import package_facts

    return package_facts(_packages(spark))


@query("SELECT * FROM " + values("file_id, name, version, author, url, license, name_source, verified", *_CLAIMS))
def idy_claims(spark, sf_dir):
    """One row of identity claims for each package."""
    from faktum.sources.packages import identity, package_facts

    own = identity(package_facts(_packages(spark)))
    return own.select("file_id", *(F.col(f"{c}.value").alias(c) for c in ("name", "version", "author", "url", "license")), F.col("name.source").alias("name_source"), "verified")


TREES = (("j", "json", b'{"a": [1, 2.5, null]}'), ("t", "toml", b"when = 2020-01-02\n[a]\nb = nan\nc = [1]\n"), ("p", "plist", b"<plist version='1.0'><dict><key>k</key><data>AAE=</data></dict></plist>"), ("y", "yaml", b"1: x\nlist:\n  - a\n"), ("bad", "toml", b"= ="))


_TREES = (("bad", "toml", None, None, "toml-parse"), ("j", "json", '{"a":[1,2.5,null]}', None, None), ("p", "plist", '{"k":"AAE="}', None, None), ("t", "toml", '{"a":{"b":null,"c":[1]},"when":"2020-01-02"}', "1", None), ("y", "yaml", '{"1":"x","list":["a"]}', None, None))


@query("SELECT * FROM " + values("file_id, kind, tree, c0, stage", *_TREES))
def jsn_trees(spark, sf_dir):
    """JSON, TOML, plist and YAML as values that SQL can navigate."""
    from faktum.sources.packages import trees

    own = trees(rows(spark, "file_id string, kind string, content binary", *TREES))
    return own.select("file_id", "kind", F.to_json("tree").alias("tree"), F.expr("try_variant_get(tree, '$.a.c[0]', 'string')").alias("c0"), F.substring_index("error", ":", 1).alias("stage"))
