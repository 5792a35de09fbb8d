"""Identification of a file from its path and bytes, as one cascade of expressions.

Content decides first (magic bytes, shebang, markup, manifests), then the
file's name, then weighted patterns of scripting languages, then the
extension.  Only archives whose kind lies inside a compressed stream are
opened, by an Arrow pass over those rows (`faktum.sources.peek`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions import languages
from faktum.operators import file_types as T

#: First bytes, in hexadecimal, in the order of their tests.
MAGIC = [
    ("0061736D01000000", "wasm"), ("7F454C46", "elf"), ("4D5A", "pe"), ("4D534346", "cab"), ("FEEDFACE", "macho"), ("FEEDFACF", "macho"), ("CEFAEDFE", "macho"), ("CFFAEDFE", "macho"), ("BEBAFECA", "macho"),
    ("FFD8FF", "jpeg"), ("89504E470D0A1A0A", "png"), ("4C0000000114020000000000C000000000000046", "lnk"), ("52617221", "rar"), ("46617364", "applescript"), ("49545346", "chm"), ("7B5C727466", "rtf"), ("255044462D", "pdf"),
    ("62706C697374", "plist"), ("78617221", "pkg_macos"), ("43723234", "crx"), ("EDABEEDB", "rpm"), ("377ABCAF271C", "7z"), ("3C3F706870", "php"),
]
#: Interpreters.
SHEBANGS = {
    "shell": "sh bash zsh dash ash ksh fish tcsh csh atf-sh", "makefile": "make gmake", "python": "python python2 python3", "javascript": "node nodejs deno bun", "ruby": "ruby", "perl": "perl perl5", "php": "php php8 php7", "lua": "lua luajit",
}
#: Whole file names, in lower case.
MANIFESTS = {
    "package.json": "package.json", "package-lock.json": "package-lock.json", "go.mod": "go.mod", "go.sum": "go.sum", "requirements.txt": "requirements.txt", "poetry.lock": "poetry.lock", "pipfile.lock": "pipfile.lock",
    "gemfile.lock": "gemfile.lock", "composer.lock": "composer.lock", "yarn.lock": "yarn.lock", "pnpm-lock.yaml": "pnpm-lock.yaml", "extension.vsixmanifest": "vsix_manifest", ".pkginfo": "text", ".buildinfo": "text", ".mtree": "text",
    "pkg-info": "pkg_info", "metadata": "pkg_info", "action.yml": "github_actions", "action.yaml": "github_actions",
}
NAMES = {
    "composer.json": "composer.json", "binding.gyp": "gyp", "cargo.toml": "cargo.toml", "cargo.lock": "cargo.lock", "pyproject.toml": "pyproject.toml", "meta.json": "pkg_info", "metadata.json": "pkg_info",
    "meson.build": "makefile", "meson.options": "makefile", "meson_options.txt": "makefile", ".srcinfo": "src_info",
}
XML_STARTS = ["<rss ", "<feed ", "<RDF ", "<configuration>", "<configuration ", "<manifest ", "<Configuration "]
HTML_MARKS = ["<!doctype html", "<html", "<head", "<body", "<script", "<div", "<span", "<p>", "<meta"]
DATA_FORMATS = "yaml yml json toml ini cfg conf properties txt text md markdown rst adoc csv tsv log svg xml service erl hrl elv nu fish".split()
#: Languages whose extension goes before a shell's interpreter line.
JUKED = ["javascript", "typescript", "python", "ruby", "php", "perl", "lua"]
MAY_BE_OVERRIDDEN = ["zip", "jar", "xpi", "whl", "ooxml", "odf", "cab", "chm", "rar", "7z"]
HEAD = languages.HEAD


def case(pairs: list[tuple[Column, Column | str]], other: Column | None = None) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return out if other is None else out.otherwise(other)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]*\z", 0)


def stem(path: Column) -> Column:
    """The base name without its last extension; leading dots are no extension."""
    return F.regexp_replace(basename(path), r"\A(\.*[^.].*)\.[^.]*\z", "$1")


def extension(path: Column) -> Column:
    """In lower case; '' without one."""
    return F.lower(F.regexp_extract(basename(path), r"(?s)\A.+\.([^.]*)\z", 1))


def latin(content: Column) -> Column:
    """A character for each byte."""
    return F.decode(content, "ISO-8859-1")


def by_extension(path: Column) -> Column:
    lower = F.lower(basename(path))
    compound = [(lower.endswith(k), F.lit(v)) for k, v in T.COMPOUND.items()]
    table = F.create_map(*(F.lit(y) for x in T.by_extension().items() for y in x))
    ext = extension(path)
    plain = F.when(F.length(ext) <= 15, F.try_element_at(table, ext))
    drop_in = path.rlike(r"\.service\.d[/\\]") & lower.endswith(".conf")
    return case([(drop_in, F.lit("systemd_service")), *compound, (lower.rlike(r"\.so\.[0-9.]+\z"), F.lit("elf"))], plain)


def by_name(path: Column) -> Column:
    name = basename(path)
    lower = F.lower(name)
    ext = by_extension(path)
    table = F.create_map(*(F.lit(y) for x in (NAMES | {k: v for k, v in MANIFESTS.items() if k not in ("go.mod", "go.sum", "requirements.txt") and not k.endswith((".lock", "lock.yaml"))}).items() for y in x))
    return case(
        [
            (lower.endswith(".registry.json"), "registry"),
            (lower.endswith(".vsixmanifest"), "vsix_manifest"),
            (name.rlike(r"\A(?:Dockerfile\z|[Dd]ockerfile\.|Containerfile(?:\z|\.))"), "dockerfile"),
            (name.rlike(r"\A(?:GNU)?[Mm]akefile") & name.rlike(r"\A(?:Makefile|GNUmakefile)"), "makefile"),
            (name == "PKGBUILD", "shell"),
            (path.rlike(r"(?is)\.github[/\\]workflows[/\\].*\.ya?ml\z") & path.rlike(r"\.github[/\\]workflows[/\\]"), "github_actions"),
            (F.regexp_extract(lower, r"\A[^.\-]*", 0).isin("license", "licence", "copying") & (ext.isNull() | (ext == "text")), "text"),
        ],
        F.try_element_at(table, lower),
    )


def by_manifest(path: Column) -> Column:
    """Lock files and manifests known by their whole names."""
    return F.try_element_at(F.create_map(*(F.lit(y) for x in MANIFESTS.items() for y in x)), F.lower(basename(path)))


def shebang(head: Column) -> Column:
    line = F.regexp_extract(F.substring(head, 1, 128), r"\A#!([^\n]*)", 1)
    rest = F.when(line.rlike(r"\A/usr/bin/env[ \t]"), F.regexp_replace(line, r"\A/usr/bin/env[ \t]+", "")).otherwise(F.regexp_replace(line, r"\A.*/", ""))
    name = F.regexp_extract(rest, r"\A[^ \t\x00]*", 0)
    table = F.create_map(*(F.lit(y) for label, own in SHEBANGS.items() for x in own.split() for y in (x, label)))
    return F.when(head.startswith("#!"), F.try_element_at(table, name))


def markup(head: Column) -> Column:
    svg = head.rlike(r"\A<svg[ >]") | (head.rlike(r"\A<(?:\?xml|!DOCTYPE)") & F.substring(head, 1, 1024).rlike("<svg[ >]"))
    xml = head.startswith("<?xml") | reduce(lambda a, b: a | b, (head.startswith(x) for x in XML_STARTS)) | (head.rlike(r"\A<Project[ \t]") & F.substring(head, 1, 512).contains("schemas.microsoft.com/developer/msbuild"))
    return case([(svg, F.lit("svg")), (xml, F.lit("xml"))])


def is_plist(head: Column) -> Column:
    return F.substring(head, 1, 256).rlike("<plist|<!DOCTYPE plist")


def looks_like_html(head: Column) -> Column:
    low = F.lower(F.substring(head, 1, HEAD))
    return reduce(lambda a, b: a | b, (low.contains(x) for x in HTML_MARKS))


def is_workflow(path: Column, head: Column) -> Column:
    lines = F.filter(F.split(F.substring(head, 1, 16384), "\n"), lambda x: ~x.rlike(r"\A(?:---|#|[ \t]|\s*\z)") & x.contains(":"))
    keys = F.transform(lines, lambda x: F.regexp_replace(F.substring_index(x, ":", 1), r"\A['\" ]+|['\" ]+\z", ""))
    return extension(path).isin("yml", "yaml") & F.array_contains(keys, "on") & F.array_contains(keys, "jobs")


def zip_kind(path: Column, raw: Column) -> Column:
    ext = extension(path)
    same = [x for x in ("xpi", "whl", "conda", "egg", "nupkg", "ipa", "vsix")]
    ooxml = "docx xlsx pptx docm xlsm pptm dotx dotm xltx xltm".split()
    odf = [*T.EXTENSIONS["odf"].split(), "odf"]
    plain = [*T.EXTENSIONS["zip"].split(), "zip", "jar", "war", "ear", *same]
    return case(
        [
            (ext.isin("jar", "war", "ear"), F.lit("jar")),
            (ext.isin(same), ext),
            (ext == "apk", F.lit("apk_android")),
            (raw.contains("extension.vsixmanifest"), F.lit("vsix")),
            (ext.isin(ooxml), F.lit("ooxml")),
            (ext.isin(odf), F.lit("odf")),
            (~ext.isin(plain) & raw.contains("[Content_Types].xml"), F.lit("ooxml")),
            (raw.contains("application/vnd.oasis.opendocument."), F.lit("odf")),
        ],
        F.lit("zip"),
    )


def magic(path: Column, content: Column) -> Column:
    """The type that the bytes (with the path's ending, for kinds that share their bytes) say, or null.  Kinds inside compressed streams are left to `peek`."""
    n = F.octet_length(content)
    hexes = F.hex(F.substring(content, 1, 64))
    head = latin(F.substring(content, 1, 16384))
    raw = latin(content)
    lower = F.lower(basename(path))
    ext = extension(path)
    ends = lambda *xs: reduce(lambda a, b: a | b, (lower.endswith(x) for x in xs))
    descriptors = F.transform(F.sequence(F.lit(16), F.lit(22)), lambda s: F.substring(content, s * 2048 + 2, 5))
    iso = F.exists(descriptors, lambda d: latin(d).isin("CD001", "BEA01", "NSR02", "NSR03", "TEA01"))
    last = F.substring(content, -512, 512)
    dmg = (n >= 512) & (F.hex(F.substring(last, 1, 4)) == "6B6F6C79") & (F.conv(F.hex(F.substring(last, 5, 4)), 16, 10).cast("long") >= 4) & (F.conv(F.hex(F.substring(last, 9, 4)), 16, 10).cast("long") == 512)
    major, fat = (F.conv(F.substring(hexes, a, k), 16, 10).cast("long") for a, k in ((13, 4), (9, 8)))
    first = F.trim(latin(F.substring(content, 9, 16)))
    start = lambda x: hexes.startswith(x)
    gz = case([(ends(".apk"), F.lit("apk_alpine")), (ends(".crate"), F.lit("crate")), (ends(".pkg.tar.gz"), F.lit("pkg_arch")), (ends(".tar.gz", ".tgz"), F.lit("tar.gz"))], F.lit("gz"))
    xz = case([(ends(".pkg.tar.xz"), F.lit("pkg_arch")), (ends(".tar.xz", ".txz"), F.lit("tar.xz"))], F.lit("xz"))
    zst = case([(ends(".xbps"), F.lit("xbps")), (ends(".tar.zst", ".tzst"), F.lit("tar.zst"))], F.lit("zst"))
    manifest = F.lower(basename(path))
    chrome = (manifest == "manifest.json") & raw.contains('"manifest_version"') & raw.rlike('"(?:permissions|content_scripts|background|host_permissions)"')
    named = by_manifest(path)
    return F.when(
        n >= 2,
        case(
            [
                (dmg, F.lit("dmg")),
                (iso, F.lit("iso")),
                (start("00051607"), F.lit("unknown")),
                (start("504B"), zip_kind(path, raw)),
                (start("CAFEBABE") & (n >= 8), F.when(major.between(45, 70) | (fat > 16), "java_class").otherwise("macho")),
                (start("D0CF11E0A1B11AE1"), F.when(ext.isin("msi", "msp", "mst", "msm"), "msi").otherwise("ole_doc")),
                (start("464F5231") & (F.substring(hexes, 17, 8) == "4245414D"), F.lit("beam")),
                (hexes.rlike(r"\A6465780A(?:3[0-9]){3}00"), F.lit("dex")),
                (hexes.rlike(r"\A800[2-5]") & ext.isin("pkl", "pickle", "joblib", "pt", "pth"), F.lit("pickle")),
                (start("213C617263683E0A"), F.when(first.startswith("debian-binary"), "deb").otherwise("static-lib")),
                (start("1F8B"), gz),
                (start("FD377A58"), xz),
                (start("425A68"), F.when(ends(".tar.bz2", ".tbz2", ".tbz"), "tar.bz2").otherwise("bz2")),
                (start("28B52FFD"), zst),
                *((start(x), F.lit(label)) for x, label in MAGIC),
                (shebang(head).isNotNull(), shebang(head)),
                (head.startswith("<") & is_plist(head), F.lit("plist")),
                (head.startswith("<") & markup(head).isNotNull(), markup(head)),
                (F.substring(hexes, 3, 6) == "0D0D0A", F.lit("python_bytecode")),
                (tampered_pe(content), F.lit("pe")),
                (~head.startswith("<") & F.substring(head, 1, 64).contains("<") & is_plist(head), F.lit("plist")),
                (is_workflow(path, head), F.lit("github_actions")),
                (chrome, F.lit("chrome_manifest")),
                (manifest.endswith(".vsixmanifest"), F.lit("vsix_manifest")),
            ],
            named,
        ),
    )


def tampered_pe(content: Column) -> Column:
    """Whether a portable executable begins at one of the bytes 1 to 62: its mark there, and its signature where it says."""
    hexes = F.hex(F.substring(content, 1, 130))
    byte = lambda i: F.conv(F.substring(hexes, 2 * i + 1, 2), 16, 10).cast("long")

    def begins(i: Column) -> Column:
        at = byte(i + 60) + 256 * byte(i + 61) + 65_536 * byte(i + 62) + 16_777_216 * byte(i + 63)
        near = (F.octet_length(content) - i >= 64) & (at + i + 4 <= F.octet_length(content))
        return (F.substring(hexes, 2 * i + 1, 4) == "4D5A") & near & (F.hex(F.substring(content, (at + i + 1).cast("int"), F.lit(4))) == "50450000")

    return F.substring(hexes, 3, 126).contains("4D5A") & F.exists(F.sequence(F.lit(1), F.lit(62)), begins)


def identify(files: DataFrame, peek: Column | None = None) -> DataFrame:
    """files (path, content, forced_type) with file_type, source, extension_type and extension_mismatch.

    extension_type is the name's type where it differs from what the bytes say; where the extension goes before an
    interpreter line, it is the type that this line claims.  An extension that nobody knows misleads as well.

    peek: what an archive's compressed inside says (null: nothing); it goes before what its first bytes say.
    """
    path, content = F.col("path"), F.col("content")
    files = files.withColumn("_magic", magic(path, content) if peek is None else F.coalesce(peek, magic(path, content))).withColumn("_name", by_name(path)).withColumn("_ext", F.coalesce("_name", by_manifest(path), by_extension(path)))
    open_still = F.col("_magic").isNull() & F.col("_name").isNull() & (F.col("_ext").isNull() | F.col("_ext").isin(MAY_BE_OVERRIDDEN)) & ~extension(path).isin(DATA_FORMATS)
    files = files.withColumn("_guess", languages.language(F.when(open_still, content)))
    head = latin(F.substring(content, 1, HEAD))
    by_bang = shebang(head).isNotNull() & (F.col("_magic") == shebang(head))
    juked = F.coalesce(by_bang & (F.col("_magic") == "shell") & F.col("_ext").isin(JUKED), F.lit(False))
    ext_ok = F.col("_ext").isNotNull() & ~((F.col("_ext") == "html") & ~looks_like_html(head))
    forced = F.col("forced_type").isNotNull()
    kind = case(
        [(forced, F.col("forced_type")), (juked, F.col("_ext")), (F.col("_magic").isNotNull(), F.col("_magic")), (F.col("_name").isNotNull(), F.col("_name")), (F.col("_guess").isNotNull(), F.col("_guess")), (ext_ok, F.col("_ext"))],
        F.lit("unknown"),
    )
    source = case(
        [(forced, F.lit("forced")), (juked, F.lit("extension-overrides-shebang")), (by_bang, F.lit("shebang")), (F.col("_magic") == "github_actions", F.lit("heuristic")), ((F.col("_magic") == by_manifest(path)) | F.col("_magic").isin("chrome_manifest", "vsix_manifest"), F.lit("filename")), (F.col("_magic").isNotNull(), F.lit("magic")), (F.col("_name").isNotNull(), F.lit("filename")), (F.col("_guess").isNotNull(), F.lit("heuristic")), (ext_ok, F.lit("extension"))],
        F.lit("heuristic"),
    )
    benign = basename(path).startswith("._") | ((F.col("_ext") == "zip") & F.lower(basename(path)).endswith(".apk")) | F.col("_magic").isin("npm", "pkg_freebsd", "pkg_arch", "python_sdist", "oci_image", "xbps", "gentoo_binpkg") | ((F.col("_ext") == "html") & (F.col("_magic") == "xml") & F.lower(head).rlike("<!doctype html|<html"))
    files = files.withColumn("file_type", kind).withColumn("source", source)
    # only what the bytes decided can differ from the name
    by_content = ~forced & (F.col("_magic").isNotNull() | F.col("_guess").isNotNull()) & F.col("source").isin("magic", "shebang", "heuristic")
    differs = F.when(juked & ~forced, F.col("_magic")).when(by_content & (F.col("_ext") != F.col("file_type")), F.col("_ext"))
    workflow = (F.col("file_type") == "github_actions") & extension(path).isin("yml", "yaml")
    unknown = by_content & F.col("_ext").isNull() & basename(path).rlike(r"(?s)\A.+\.[^.]*\z") & ~workflow
    files = files.withColumn("extension_type", differs)
    mismatch = (F.col("extension_type").isNotNull() | unknown) & ~F.coalesce(benign, F.lit(False))
    return files.withColumn("extension_mismatch", F.coalesce(mismatch, F.lit(False))).drop("_magic", "_ext", "_name", "_guess")
