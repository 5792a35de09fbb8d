"""The dimension of file types: label, group, container and, by rule, extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Labels of each group.
GROUPS = {
    "binary": "macho elf pe java_class python_bytecode beam wasm dex static-lib lnk",
    "script": "shell batch jcl vbs python javascript ruby php perl lua powershell groovy scala kotlin zig elixir clojure applescript",
    "source": "typescript go rust java csharp swift objective_c c",
    "config": "package.json package-lock.json vsix_manifest chrome_manifest cargo.toml cargo.lock requirements.txt poetry.lock pipfile.lock gemfile.lock composer.lock yarn.lock pnpm-lock.yaml pyproject.toml composer.json json gyp github_actions systemd_service desktop_entry xml pkg_info src_info registry go.mod go.sum plist makefile dockerfile",
    "archive": "jar zip tar tar.gz tar.bz2 tar.xz tar.zst gz bz2 xz lzma zst 7z rar deb rpm pkg_macos dmg iso cab chm crx xpi whl gem apk_android apk_alpine npm crate conda egg nupkg ipa vsix pkg_freebsd pkg_arch python_sdist oci_image xbps gentoo_binpkg asar msi",
    "document": "rtf ole_doc ooxml pdf odf",
    "image": "jpeg png svg",
    "text": "html markdown text",
    "data": "pickle data unknown",
}
#: Archive formats and codecs.
ARCHIVES = {
    "zip": "jar zip crx xpi whl apk_android conda egg nupkg ipa vsix odf",
    "tar": "tar tar.gz tar.bz2 tar.xz tar.zst gem apk_alpine npm crate pkg_freebsd pkg_arch python_sdist oci_image xbps gentoo_binpkg",
    "7z": "7z", "rar": "rar", "ar": "deb", "xar": "pkg_macos", "iso9660": "iso", "cab": "cab", "asar": "asar",
}
CODECS = {"gzip": "tar.gz gz apk_alpine npm crate python_sdist", "bzip2": "tar.bz2 bz2", "xz": "tar.xz xz", "zstd": "tar.zst zst pkg_freebsd xbps", "lzma": "lzma"}
#: Extensions that differ from their type's label.  A label without a dot or underscore is also an extension.
EXTENSIONS = {
    "macho": "dylib bundle", "elf": "so ko", "pe": "exe dll sys scr cpl ocx drv efi pyd", "shell": "sh bash ksh zsh csh tcsh dash fish command ebuild eclass", "batch": "bat cmd", "vbs": "vbe wsf wsc wsh",
    "python": "py pyw pyi pth", "javascript": "js mjs cjs jsx jse", "typescript": "ts tsx mts cts", "rust": "rs", "java_class": "class", "python_bytecode": "pyc pyo", "ruby": "rb rbs gemspec", "php": "php3 php4 php5 php7 phtml",
    "perl": "pl pm t", "csharp": "cs", "powershell": "ps1 psm1 psd1", "objective_c": "m mm", "groovy": "gradle", "scala": "sc", "kotlin": "kt kts", "elixir": "ex exs", "clojure": "clj cljs cljc cljr edn bb",
    "c": "h cpp hpp cc cxx hxx hh pas dpr asm s nasm", "gyp": "gypi", "systemd_service": "service", "desktop_entry": "desktop", "xml": "csproj vbproj fsproj proj props targets vcxproj xaml config settings nuspec wsdl xsd xsl xslt",
    "zip": "apk epub aar phar pyz msix appx msixbundle appxbundle aab apks xapk cbz", "7z": "cb7", "rar": "cbr", "deb": "udeb", "static-lib": "a", "rpm": "srpm", "pkg_macos": "pkg", "cab": "msu", "applescript": "scpt", "plist": "resx",
    "ole_doc": "doc msg dot ppt pps pot ppa xls xlt xla", "msi": "msp mst msm", "ooxml": "docx xlsx pptx docm xlsm pptm dotx dotm xltx xltm xlam ppam potx potm ppsx ppsm sldx sldm", "jpeg": "jpg jpe jfif", "pickle": "pkl joblib",
    "html": "htm", "markdown": "md rmd qmd rnw", "makefile": "mk mak", "dockerfile": "containerfile", "odf": "odt ods odp odg ott ots otp odm oth otg odb odc odi",
    "text": "css scss sass less styl pcss postcss vim lsp lisp el cl scm ptl ml mli mll mly mld eliom eliomi sql ddl dml cypher cql smali patch diff m4 types symbols baseline proto txt b64 base64", "data": "dat bin payload raw",
}
#: Endings of more than one part, in the order of their tests.
COMPOUND = {
    ".gpkg.tar": "gentoo_binpkg", ".pkg.tar": "pkg_arch", ".pkg.tar.gz": "pkg_arch", ".pkg.tar.xz": "pkg_arch", ".pkg.tar.zst": "pkg_arch", ".tar.gz": "tar.gz", ".tgz": "tar.gz", ".tar.bz2": "tar.bz2", ".tbz2": "tar.bz2", ".tbz": "tar.bz2",
    ".tar.xz": "tar.xz", ".txz": "tar.xz", ".tar.zst": "tar.zst", ".tzst": "tar.zst", ".crate": "crate", ".xbps": "xbps", ".gem": "gem", ".tar": "tar", ".jar": "jar", ".war": "jar", ".ear": "jar",
}
#: Labels that are no extensions of themselves.
_NOT_SELF = {"macho", "pe", "shell", "batch", "python", "javascript", "typescript", "rust", "ruby", "perl", "csharp", "powershell", "kotlin", "elixir", "clojure", "makefile", "text", "data", "unknown", "npm", "tar", "gem", "crate", "xbps", "jar", "registry"}


def labels() -> list[str]:
    return [x for own in GROUPS.values() for x in own.split()]


def by_extension() -> dict[str, str]:
    out = {x: x for x in labels() if x not in _NOT_SELF and x.isalnum()}
    return out | {e: label for label, own in EXTENSIONS.items() for e in own.split()}


def _inverse(table: dict[str, str]) -> dict[str, str]:
    return {x: k for k, own in table.items() for x in own.split()}


def file_types(spark: SparkSession) -> DataFrame:
    """label, grp, archive_format, compression, is_archive, is_binary, is_source, is_structured: a row for each type."""
    archive, codec = _inverse(ARCHIVES), _inverse(CODECS)
    rows = [(x, g, archive.get(x), codec.get(x), g == "archive", g == "binary", g in ("script", "source"), g == "config") for g, own in GROUPS.items() for x in own.split()]
    return spark.createDataFrame(rows, "label string, grp string, archive_format string, compression string, is_archive boolean, is_binary boolean, is_source boolean, is_structured boolean")
