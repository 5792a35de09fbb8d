"""Readers of containers, binaries and sources, on files made in place."""

import struct

import pytest

from faktum import queries_sources as Q
from faktum.sources import binaries, containers
from faktum.sources.python_source import symbols_of


def test_zip_tar_and_ar():
    z = {m["path"]: m for m in containers.members_of(Q.sample_zip(), "zip")}
    assert z["d/"]["entry_type"] == "directory" and z["d/a.txt"]["method"] == "deflate" and z["d/a.txt"]["mtime_unix"] == 1_577_934_246 and z["d/report.pdf.exe"]["mtime_unix"] is None
    t = {m["path"]: m for m in containers.members_of(Q.sample_tar(), "tar")}
    assert t["t/link"]["entry_type"] == "symlink" and t["t/link"]["linkname"] == "../../etc/passwd" and t["t/b"]["mode"] == 0o4755
    assert [m["path"] for m in containers.members_of(Q.sample_ar(), "ar")] == ["debian-binary", "data.tar"]


@pytest.mark.parametrize("kind", list(containers.READERS))
def test_broken_archives_are_error_rows(kind):
    for data in (b"", b"PK", b"\0" * 100, Q.sample_zip()[:40]):
        out = containers.members_of(data, kind)
        assert all(m["ord"] == -1 and "error" in m for m in out) or kind == "tar" or out == []


@pytest.mark.parametrize("kind", list(binaries.READERS))
def test_broken_binaries_never_fail(kind):
    for data in (b"", b"MZ", b"\x7fELF\x02\x01", bytes(300), Q.sample_elf()[:120], b"\xca\xfe\xba\xbe" + bytes(40)):
        assert isinstance(binaries.facts_of(kind, data), list)


def test_peeks():
    assert containers.peek_type("x.tgz", Q.sample_tar("package/", True, ("package.json", "a"))) == "npm"
    assert containers.peek_type("x.tgz", Q.sample_tar("p-1/", True, ("PKG-INFO", "a"))) == "python_sdist"
    assert containers.peek_type("x.tgz", Q.sample_tar("p/", True)) is None
    assert containers.peek_type("x.tar", Q.sample_tar("", False, ("oci-layout", "index.json"))) == "oci_image"


def test_elf():
    rows = binaries.facts_of("elf", Q.sample_elf())
    metrics = {r["name"]: r["value"] for r in rows if r["view"] == "metric"}
    assert metrics["elf.wx_segment_count"] == 1 and metrics["elf.entry_outside_segments"] == 0 and metrics["elf.entry_in_last_segment"] == 0
    sections = {r["name"]: r for r in rows if r["view"] == "section"}
    assert sections[".text"]["flags"] == ["alloc", "executable"] and sections[".text"]["entropy"] == 6.0 and sections[".data"]["entropy"] == 0.0


def test_small_formats():
    metrics = lambda kind, data: {r["name"]: r["value"] for r in binaries.facts_of(kind, data) if r["view"] == "metric"}
    assert metrics("png", Q.sample_png())["png.trailing_bytes"] == 4 and metrics("png", Q.sample_png())["png.width"] == 3
    java = binaries.facts_of("java_class", Q.sample_class())
    assert [r["name"] for r in java if r["view"] == "function"] == ["run"] and [r["name"] for r in java if r["view"] == "reference"] == ["Main"]
    assert metrics("python_bytecode", b"\xcb\r\r\n" + struct.pack("<III", 0, 5, 7)) == {"pyc.magic": 3531.0, "pyc.flags": 0.0, "pyc.mtime": 5.0, "pyc.source_size": 7.0}
    import pickle

    assert "os.getcwd" in [r["name"].replace("posix", "os").replace("nt.", "os.") for r in binaries.facts_of("pickle", pickle.dumps(__import__("os").getcwd, 4)) if r["view"] == "import"]


def test_python_symbols():
    rows = symbols_of(Q.PYTHON[0][1])
    names = lambda kind: [r["name"] for r in rows if r["kind"] == kind]
    assert names("import") == ["os", "sys", ".x", ".y.z"] and names("function") == ["f", "g", "m"]
    assert set(names("call")) == {"os.path.join", "f"} and {"v", "w"} <= set(names("bind")) and "a.b.c" in names("member")
    metrics = {r["name"]: r["value"] for r in rows if r["kind"] == "metric"}
    assert metrics["ast.infinite_loop_count"] == 1 and metrics["ast.self_compare_count"] == 1 and metrics["ast.string_return_function_count"] == 1 and metrics["ast.op.xor"] == 1
    assert symbols_of("def x(:")[0]["kind"] == "error"


def test_comment_metrics(spark):
    got = {r.file_id: r for r in Q.cmt_metrics(spark, "").collect()}
    for file_id, r in got.items():
        own = [b for i, _, b in Q._BODIES if i == file_id]
        assert (r.total, r.lines, r.chars) == (len(own), sum(len(b.splitlines()) for b in own), sum(map(len, own))), file_id
    count = lambda name: {i: r[name] for i, r in got.items() if r[name]}
    assert count("todo_count") == {"c1": 1, "go": 1} and count("fixme_count") == {"py": 1} and count("hack_count") == {"lua": 1, "go": 1} and count("xxx_count") == {"lua": 1}
    assert count("empty_comments") == {"c1": 1, "go": 1} and count("code_in_comments") == {"js": 1, "go": 1} and count("url_in_comments") == {"c1": 1, "go": 1} and count("high_entropy_comments") == {"go": 1}
    assert got["py"].base64_in_comments == 1


def test_scan_and_stream(spark, tmp_path):
    from faktum.sources.files import scan
    from faktum.streaming.incremental import file_stream, new_contents

    (tmp_path / "in").mkdir()
    for name, data in (("a.txt", b"one"), ("b.txt", b"one"), ("c.txt", b"two")):
        (tmp_path / "in" / name).write_bytes(data)
    files = scan(spark, str(tmp_path / "in")).collect()
    assert sorted(f.basename for f in files) == ["a.txt", "b.txt", "c.txt"] and len({f.file_id for f in files}) == 2
    run = new_contents(file_stream(spark, str(tmp_path / "in"))).select("key").writeStream.format("memory").queryName("seen").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    assert run.awaitTermination(120)
    assert spark.table("seen").count() == 2


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() > 0


def test_packages(spark):
    got = {r.file_id: r for r in Q.idy_claims(spark, "").collect()}
    assert (got["npm"].name, got["npm"].version, got["npm"].author) == ("demo", "1.0.0", "A <a@b>")
    assert (got["whl"].name, got["whl"].author) == ("demo", "Bo") and got["jar"].name == "demo" and got["nupkg"].name == "Demo"
    assert (got["vsix"].name, got["vsix"].version, got["vsix"].author) == ("v", "3", "P") and got["ooxml"].author == "D" and got["bad"].name is None
    facts = {(r.file_id, r.key): r.value for r in Q.pkg_facts(spark, "").collect()}
    assert facts["npm", "script.postinstall"] == "x" and ("npm", "script.test") not in facts and facts["ooxml", "macro_count"] == "1" and facts["ooxml", "external_relationship_count"] == "1" and "error" in {k for i, k in facts if i == "bad"}


def test_trees(spark):
    import json

    got = {r.file_id: r for r in Q.jsn_trees(spark, "").collect()}
    assert json.loads(got["t"].tree) == {"when": "2020-01-02", "a": {"b": None, "c": [1]}} and got["t"].c0 == "1"
    assert json.loads(got["p"].tree) == {"k": "AAE="} and json.loads(got["j"].tree) == {"a": [1, 2.5, None]} and got["bad"].stage == "toml-parse"
    assert json.loads(got["y"].tree) == {"1": "x", "list": ["a"]}


@pytest.mark.parametrize("kind", ["npm", "whl", "jar", "nupkg", "vsix", "gem", "crate", "deb", "oci_image", "crx", "rpm", "ooxml", "lnk", "dmg", "ole_doc"])
def test_broken_packages_are_error_rows(kind):
    from faktum.sources.packages import facts_of

    for data in (b"", b"PK\3\4", b"\x1f\x8b\x08\0", bytes(600), b"\xd0\xcf\x11\xe0" + bytes(600)):
        assert isinstance(facts_of(kind, data), list)


def test_references_of_locks_and_images(spark):
    from faktum.operators.references import references

    rows = [
        ("npm", "package-lock.json", '{"packages": {"": {"version": "1.0.0"}, "node_modules/a/node_modules/@s/b": {"version": "2.0.0", "integrity": "sha512-x"}}, "dependencies": {"c": {"version": "1.2.3"}, "d": {}}}'),
        ("pnpm", "pnpm-lock.yaml", "packages:\n  /@s/b@2.0.0(react@18.0.0):\n    resolution: {integrity: sha512-y}\n  c@1.0.0: {}\n"),
        ("poetry", "poetry.lock", '[[package]]\nname = "Typing_Ext"\nversion = "4.0"\n'),
        ("pip", "pipfile.lock", '{"default": {"A.b": {"version": "==1.0"}, "g": {"git": "x"}}, "develop": {"c": {"version": "==2"}}}'),
        ("php", "composer.lock", '{"packages": [{"name": "v/p", "version": "v1"}], "packages-dev": [{"name": "v/q", "version": "2"}]}'),
        ("rust", "cargo.toml", '[package]\nname = "x"\nrepository = "https://github.com/O/R"\n[dependencies]\na = "1"\n'),
        ("ci", "github_actions", "- uses: docker://ghcr.io/o/Tool:1\n- uses: docker://alpine\n- uses: a/b@v1\n- uses: docker:////evil/x\n"),
        ("bad", "composer.lock", "{"),
    ]
    got: dict = {}
    for r in references(spark.createDataFrame(rows, "file_id string, file_type string, text string")).orderBy("file_id", "ord").collect():
        got.setdefault(r.file_id, []).append((r.locator, r.pin) if r.pin else r.locator)
    assert got == {
        "npm": [("pkg:npm/%40s/b@2.0.0", "sha512-x"), "pkg:npm/c@1.2.3"], "pnpm": [("pkg:npm/%40s/b@2.0.0", "sha512-y"), "pkg:npm/c@1.0.0"], "poetry": ["pkg:pypi/typing-ext@4.0"], "pip": ["pkg:pypi/a-b@1.0", "pkg:pypi/c@2"],
        "php": ["pkg:composer/v/p@v1", "pkg:composer/v/q@2"], "rust": ["pkg:github/o/r"], "ci": ["pkg:oci/tool?repository_url=ghcr.io%2Fo&tag=1", "pkg:oci/alpine", "pkg:github/a/b@v1"],
    }


def test_late_manifests():
    import io
    import tarfile

    from faktum.sources.packages import facts_of

    def tar(last, body, root, count, size):
        out = io.BytesIO()
        with tarfile.open(fileobj=out, mode="w:gz", compresslevel=1) as t:
            for name, data in [*((f"{root}/f{k}", bytes(size)) for k in range(count)), (f"{root}/{last}", body)]:
                m = tarfile.TarInfo(name)
                m.size = len(data)
                t.addfile(m, io.BytesIO(data))
        return out.getvalue()

    info, manifest = b"Metadata-Version: 2.1\nName: p\n", b'{"name": "n"}'
    for count, size in ((600, 10), (20, 1 << 20)):
        data = tar("PKG-INFO", info, "p-1", count, size)
        assert containers.peek_type("p-1.tar.gz", data) == "python_sdist" and ("name", "p") in facts_of("python_sdist", data)
        assert ("name", "n") in facts_of("npm", tar("package.json", manifest, "package", count, size))
    assert containers.peek_type("n.tgz", tar("package.json", manifest, "package", 600, 10)) == "npm"
    assert facts_of("npm", tar("x", b"", "package", 1, 1))[0][0] == facts_of("python_sdist", data[: len(data) // 2])[0][0] == "error"
    assert facts_of("npm", tar("package.json", bytes(2 << 20), "package", 1, 1))[0][0] == "error"
