"""The truth table of identification."""

from faktum.queries import QUERIES

WANT = {
    "a.wasm": "wasm", "x": "elf", "setup.txt": "pe", "A.class": "java_class", "fat": "macho", "d.doc": "ole_doc", "d.msi": "msi", "c.dex": "dex", "o.a": "static-lib", "o.deb": "deb", "z.tar.gz": "tar.gz", "z.apk": "apk_alpine", "a.apk": "apk_android",
    "z.txz": "tar.xz", "a.docx": "ooxml", "a.zip": "zip", "a": "ooxml", "b": "odf", "s": "shell", "s.py": "python", "s2.py": "python", "n.js": "javascript", "w": "unknown", "i2.xml": "svg", "l.plist": "plist", "m.pyc": "python_bytecode",
    ".github/ci.yml": "github_actions", "x.yml": "unknown", "package.json": "package.json", "manifest.json": "chrome_manifest", "Dockerfile": "dockerfile", "LICENSE": "text", "COPYING.md": "markdown", "lib.so.6": "elf", "h.html": "html",
    "h2.html": "unknown", "data.pkl": "pickle", "e": "unknown", "k": "javascript", "script": "perl", "prose": "unknown", "q.zip": "python",
}


def test_truth_table(spark):
    got = {r.path: r for r in QUERIES["id_identify"](spark, "").collect()}
    assert {k: got[k].file_type for k in WANT} == WANT
    assert {k for k, r in got.items() if r.extension_mismatch} == {"setup.txt", "i2.xml", "q.zip", "s2.py"}
    assert got["s2.py"].source == "extension-overrides-shebang" and got["s"].source == "shebang" and got["package.json"].source == "filename"


def test_forced_type(spark):
    from faktum.operators.identify import identify

    row = identify(spark.createDataFrame([("a.py", b"#!/bin/sh", "text"), (None, b"", None)], "path string, content binary, forced_type string")).collect()
    assert (row[0].file_type, row[0].source, row[0].extension_mismatch) == ("text", "forced", False)
    assert row[1].file_type == "unknown"
