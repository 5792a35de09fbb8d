"""Identity facts of packages and trees of structured documents, as rows (file_id, key, value).

One Arrow pass opens a package far enough to read its one manifest.  npm
packages, sdists and crates are streamed up to their manifest; what can't be read, or
has none, gives an error row.
"""

from __future__ import annotations

import datetime
import email.parser
import io
import json
import math
import plistlib
import re
import struct
import tarfile
import tomllib
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of one control archive or metadata, and of one manifest.
LIMIT = 16 << 20
MANIFEST = 1 << 20

FACTS = pa.schema([("file_id", pa.string()), ("ord", pa.int64()), ("key", pa.string()), ("value", pa.string())])
FACTS_DDL = "file_id string, ord long, key string, value string"


# structured documents


def _plain(x):
    """JSON's kinds only: times and bytes become strings, keys too, odd numbers null."""
    import base64

    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    if isinstance(x, (datetime.datetime, datetime.date, datetime.time)):
        return x.isoformat()
    if isinstance(x, bytes):
        return base64.b64encode(x).decode()
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (str, int, float, bool)) else str(x)


def tree_of(kind: str, data: bytes) -> str:
    """The document as JSON."""
    if kind == "json":
        own = json.loads(data)
    elif kind == "yaml":
        import yaml

        own = yaml.load(data, yaml.BaseLoader)
    elif kind == "toml":
        own = tomllib.loads(data.decode())
    elif kind == "plist":
        own = plistlib.loads(data)
    else:
        raise ValueError(f"no reader of {kind}")
    return json.dumps(_plain(own), ensure_ascii=False)


def _trees(batches):
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for kind, data in zip(batch.column("kind").to_pylist(), batch.column("content"), strict=True):
            try:
                tree, error = tree_of(kind, data.as_py() or b""), None
            except Exception as e:  # hostile input is data
                tree, error = None, f"{kind}-parse: {e}"[:300]
            out[0].append(tree)
            out[1].append(error)
        yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("kind"), pa.array(out[0], pa.string()), pa.array(out[1], pa.string())], names=["file_id", "kind", "tree", "error"])


def trees(files: DataFrame) -> DataFrame:
    """files: (file_id, kind, content) to (file_id, kind, tree as VARIANT, error)."""
    own = files.select("file_id", "kind", "content").mapInArrow(_trees, "file_id string, kind string, tree string, error string")
    return own.withColumn("tree", F.try_parse_json("tree"))


# packages


def _members(data: bytes) -> dict[str, bytes]:
    """Small members of a zip or a (compressed) tar, by name."""
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return {i.filename: z.read(i) for i in z.infolist() if i.file_size <= 1 << 20 and re.search(r"(METADATA|MANIFEST\.MF|\.nuspec|\.vsixmanifest|package\.json|manifest\.json|core\.xml|app\.xml|pom\.properties|\[Content_Types\]\.xml|AndroidManifest\.xml)$", i.filename)}
    out = {}
    with _tar(data) as t:
        for m in t:
            if m.isfile() and m.size <= MANIFEST:
                out[m.name.removeprefix("./")] = t.extractfile(m).read()
    return out


def _tar(data: bytes):
    from faktum.sources.containers import Inflated

    return tarfile.open(fileobj=io.BufferedReader(Inflated(data)), mode="r|") if data[:2] == b"\x1f\x8b" else tarfile.open(fileobj=io.BytesIO(data), mode="r:")


def _manifest(data: bytes, pattern: str) -> bytes:
    """The first member of that name; a zip's or a tar's, read only as far as it takes.  Without one, or with one beyond the limit, an error."""
    if data[:2] == b"PK":
        own = _first(_members(data), pattern)
        if own is None:
            raise ValueError("no manifest")
        return own
    with _tar(data) as t:
        for m in t:
            if m.isfile() and re.search(pattern, m.name.removeprefix("./")):
                if m.size > MANIFEST:
                    raise ValueError(f"manifest of {m.size} bytes is beyond the limit of {MANIFEST}")
                return t.extractfile(m).read()
            t.members = []  # headers that are done aren't kept
    raise ValueError("no manifest")


def _headers(text: bytes) -> list[tuple[str, str]]:
    return [(k.lower(), str(v)) for k, v in email.parser.Parser().parsestr(text.decode("utf-8", "replace"), headersonly=True).items()]


def _first(members: dict[str, bytes], pattern: str) -> bytes | None:
    return next((members[n] for n in sorted(members, key=lambda n: (n.count("/"), n)) if re.search(pattern, n)), None)


def _xml(data: bytes, *names: str) -> list[tuple[str, str]]:
    out = []
    for e in ElementTree.fromstring(data).iter():
        name = e.tag.rpartition("}")[2]
        if name in names and (e.text or "").strip():
            out.append((name.lower(), e.text.strip()))
    return out


def npm(data: bytes) -> list[tuple[str, str]]:
    own = json.loads(data if data.lstrip()[:1] == b"{" else _manifest(data, r"^package/package\.json$"))
    out = [(k, str(own[k])) for k in ("name", "version", "homepage", "license", "description") if own.get(k)]
    repo = own.get("repository")
    out += [("repository", repo.get("url") if isinstance(repo, dict) else repo)] if repo else []
    for role, people in (("author", [own.get("author")]), ("maintainer", own.get("maintainers") or [])):
        for p in people:
            if p:
                out.append((role, p if isinstance(p, str) else f"{p.get('name', '')} <{p.get('email', '')}>"))
    hooks = ("preinstall", "install", "postinstall", "prepare", "preuninstall", "postuninstall")
    return out + [(f"script.{k}", v) for k, v in sorted((own.get("scripts") or {}).items()) if k in hooks]


def python_package(data: bytes) -> list[tuple[str, str]]:
    return _headers(_manifest(data, r"\.dist-info/METADATA$|(^|/)PKG-INFO$" if data[:2] == b"PK" else r"^(?:[^/]+/)?PKG-INFO$"))


def jar(data: bytes) -> list[tuple[str, str]]:
    text = re.sub(rb"\r?\n ", b"", _first(_members(data), r"^META-INF/MANIFEST\.MF$") or b"")
    return _headers(re.sub(rb"\r\n", b"\n", text))


def nuspec(data: bytes) -> list[tuple[str, str]]:
    return _xml(_first(_members(data), r"\.nuspec$"), "id", "version", "authors", "owners", "projectUrl", "licenseUrl", "description")


def vsix(data: bytes) -> list[tuple[str, str]]:
    root = ElementTree.fromstring(_first(_members(data), r"\.vsixmanifest$") if data[:2] == b"PK" else data)
    out = []
    for e in root.iter():
        name = e.tag.rpartition("}")[2]
        if name == "Identity":
            out += [(f"identity.{k.lower()}", v) for k, v in sorted(e.attrib.items())]
        elif name == "Property":
            out.append((f"property.{e.get('Id')}", e.get("Value") or ""))
        elif name == "Asset":
            out.append(("asset", e.get("Type") or ""))
        elif name == "Dependency" and e.get("Id"):
            out.append(("dependency", e.get("Id")))
        elif name in ("DisplayName", "Description", "Tags") and (e.text or "").strip():
            out.append((name.lower(), e.text.strip()))
    return out


def gem(data: bytes) -> list[tuple[str, str]]:
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_multi_constructor("!", lambda loader, _, node: loader.construct_mapping(node, deep=True) if isinstance(node, yaml.MappingNode) else loader.construct_sequence(node, deep=True) if isinstance(node, yaml.SequenceNode) else loader.construct_scalar(node))
    own = yaml.load(zlib.decompressobj(31).decompress(_members(data)["metadata.gz"], LIMIT), Loader)
    version = own.get("version")
    deps = own.get("dependencies") or []
    out = [(k, str(own[k])) for k in ("name", "homepage", "email", "summary") if own.get(k)] + [("version", str(version.get("version") if isinstance(version, dict) else version))]
    out += [("author", str(a)) for a in own.get("authors") or []] + [("license", str(x)) for x in own.get("licenses") or []]
    runtime = [str(d.get("name")) for d in deps if d.get("type") in (":runtime", "runtime") and d.get("name")]
    return out + [("runtime_dependency", x) for x in runtime] + [("dependency_count", str(len(deps))), ("runtime_dependency_count", str(len(runtime)))]


def crate(data: bytes) -> list[tuple[str, str]]:
    own = tomllib.loads(_manifest(data, r"^[^/]+/Cargo\.toml$").decode()).get("package", {})
    return [(k, str(own[k])) for k in ("name", "version", "repository", "homepage", "license") if own.get(k)] + [("author", a) for a in own.get("authors", [])]


def deb(data: bytes) -> list[tuple[str, str]]:
    from faktum.sources.containers import members_of

    for m in members_of(data, "ar"):
        if (m.get("path") or "").startswith("control.tar"):
            body = data[m["offset"] + 60 : m["offset"] + 60 + m["size_bytes"]]
            if m["path"].endswith(".zst"):
                import zstandard

                body = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(body)).read(LIMIT)
            return _headers(_manifest(body, r"^control$"))
    return []


def oci(data: bytes) -> list[tuple[str, str]]:
    own = _members(data)
    if "index.json" in own:
        index = json.loads(own["index.json"])
        return [("kind", "oci"), *(("digest", m.get("digest", "")) for m in index.get("manifests", [])), *(("ref", m["annotations"]["org.opencontainers.image.ref.name"]) for m in index.get("manifests", []) if "org.opencontainers.image.ref.name" in m.get("annotations", {}))]
    manifest = json.loads(own["manifest.json"])
    return [("kind", "docker"), *(("ref", t) for m in manifest for t in m.get("RepoTags") or []), ("layer_count", str(sum(len(m.get("Layers", [])) for m in manifest)))]


def crx(data: bytes) -> list[tuple[str, str]]:
    version = struct.unpack_from("<I", data, 4)[0]
    out = [("crx_version", str(version))]
    if version == 2:
        import hashlib

        size = struct.unpack_from("<I", data, 8)[0]
        digest = hashlib.sha256(data[16 : 16 + size]).hexdigest()
        out += [("public_key_sha256", digest), ("extension_id", digest[:32].translate(str.maketrans("0123456789abcdef", "abcdefghijklmnop")))]
    return out


def rpm(data: bytes) -> list[tuple[str, str]]:
    """Tags of the main header that hold strings."""
    tags = {1000: "name", 1001: "version", 1002: "release", 1004: "summary", 1010: "distribution", 1011: "vendor", 1014: "license", 1015: "packager", 1020: "url", 1021: "os", 1022: "arch"}
    at = 96
    for which in (0, 1):
        if data[at : at + 3] != b"\x8e\xad\xe8":
            raise ValueError("no header")
        count, size = struct.unpack_from(">II", data, at + 8)
        store = at + 16 + 16 * count
        if which:
            rows = [struct.unpack_from(">IIII", data, at + 16 + 16 * k) for k in range(count)]
            return [(tags[t], data[store + o : data.index(b"\0", store + o)].decode("utf-8", "replace")) for t, kind, o, _ in rows if t in tags and kind in (6, 9)]
        at = store + size + -(store + size) % 8
    return []


def office(data: bytes) -> list[tuple[str, str]]:
    own = _members(data)
    core = _xml(own["docProps/core.xml"], "creator", "lastModifiedBy", "title", "subject", "created", "modified", "revision") if "docProps/core.xml" in own else []
    app = _xml(own["docProps/app.xml"], "Application", "AppVersion", "Company", "Template", "Pages") if "docProps/app.xml" in own else []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        outside = sum(z.read(n).count(b'TargetMode="External"') for n in names if n.endswith(".rels"))
    marks = [("macro_count", sum(n.endswith("vbaProject.bin") for n in names)), ("embedded_count", sum("/embeddings/" in n for n in names)), ("control_count", sum("/activeX/" in n for n in names)), ("external_relationship_count", outside)]
    return core + app + [(k, str(v)) for k, v in marks]


def lnk(data: bytes) -> list[tuple[str, str]]:
    flags, attributes = struct.unpack_from("<II", data, 20)
    out = [("flags", str(flags)), ("file_attributes", str(attributes)), ("target_size", str(struct.unpack_from("<I", data, 52)[0])), ("show_command", str(struct.unpack_from("<I", data, 60)[0]))]
    at = 76
    if flags & 1:
        at += 2 + struct.unpack_from("<H", data, at)[0]
    if flags & 2:
        at += struct.unpack_from("<I", data, at)[0]
    for bit, name in ((4, "name"), (8, "relative_path"), (16, "working_dir"), (32, "arguments"), (64, "icon_location")):
        if flags & bit:
            n = struct.unpack_from("<H", data, at)[0]
            size = n * (2 if flags & 128 else 1)
            text = data[at + 2 : at + 2 + size].decode("utf-16-le" if flags & 128 else "latin-1", "replace")
            out.append((name, text))
            if name == "arguments":
                out.append(("argument_padding", str(len(text) - len(text.lstrip()))))
            at += 2 + size
    return out


def dmg(data: bytes) -> list[tuple[str, str]]:
    trailer = data[-512:]
    if trailer[:4] != b"koly":
        raise ValueError("no trailer")
    fork_at, fork = struct.unpack_from(">QQ", trailer, 24)
    xml_at, xml_size = struct.unpack_from(">QQ", trailer, 216)
    out = [("version", str(struct.unpack_from(">I", trailer, 4)[0])), ("data_fork_offset", str(fork_at)), ("data_fork_bytes", str(fork)), ("sector_count", str(struct.unpack_from(">Q", trailer, 492)[0]))]
    blocks = plistlib.loads(data[xml_at : xml_at + xml_size]).get("resource-fork", {}).get("blkx", []) if xml_size else []
    return out + [("partition", b.get("Name", "")) for b in blocks]


def ole2(data: bytes) -> list[tuple[str, str]]:
    """Streams and storages of a compound file, in directory order."""
    shift = struct.unpack_from("<H", data, 30)[0]
    size, first = 1 << shift, struct.unpack_from("<I", data, 48)[0]
    sector = lambda n: data[(n + 1) * size : (n + 2) * size]
    table = b"".join(sector(n) for n in struct.unpack_from("<109I", data, 76) if n < 0xFFFFFFFA)
    out, seen, at = [], set(), first
    while at < 0xFFFFFFFA and at not in seen:
        seen.add(at)
        block = sector(at)
        for k in range(0, len(block) - 127, 128):
            n, kind = struct.unpack_from("<HB", block, k + 64)
            if kind in (1, 2, 5) and n >= 2:
                name = block[k : k + n - 2].decode("utf-16-le", "replace")
                out.append(({1: "storage", 2: "stream", 5: "root"}[kind], name))
                if kind == 2:
                    out.append((f"size.{name}", str(struct.unpack_from("<I", block, k + 120)[0])))
        at = struct.unpack_from("<I", table, 4 * at)[0] if 4 * at + 4 <= len(table) else 0xFFFFFFFE
    return out


READERS = {
    "npm": npm, "package.json": npm, "whl": python_package, "python_sdist": python_package, "jar": jar, "nupkg": nuspec, "vsix": vsix, "vsix_manifest": vsix, "gem": gem, "crate": crate, "deb": deb, "oci_image": oci, "crx": crx, "rpm": rpm,
    "ooxml": office, "lnk": lnk, "dmg": dmg, "ole_doc": ole2, "msi": ole2,
}


def facts_of(kind: str, data: bytes) -> list[tuple[str, str]]:
    try:
        return READERS[kind](data)
    except Exception as e:  # hostile input is data
        return [("error", f"{kind}-parse: {type(e).__name__} {e}"[:300])]


def _run(batches):
    for batch in batches:
        rows = []
        for file_id, kind, data in zip(batch.column("file_id").to_pylist(), batch.column("file_type").to_pylist(), batch.column("content"), strict=True):
            rows += [{"file_id": file_id, "ord": k, "key": key, "value": value} for k, (key, value) in enumerate(facts_of(kind, data.as_py() or b""))]
        yield pa.RecordBatch.from_pylist(rows, schema=FACTS)


def package_facts(files: DataFrame) -> DataFrame:
    """files: (file_id, file_type, content) to (file_id, ord, key, value)."""
    return files.filter(F.col("file_type").isin(list(READERS))).select("file_id", "file_type", "content").mapInArrow(_run, FACTS_DDL)


#: Keys that name a claim, by package type, most trusted first.
CLAIMS = {"name": ["name", "identity.id", "id", "implementation-title", "bundle-symbolicname"], "version": ["version", "identity.version", "implementation-version", "bundle-version"], "author": ["author", "authors", "author-email", "maintainer", "creator", "implementation-vendor", "vendor", "packager", "identity.publisher"], "url": ["homepage", "home-page", "projecturl", "url", "repository"], "license": ["license", "licenseurl"]}


def identity(facts: DataFrame) -> DataFrame:
    """One row of claims a file: of each claim the first key that is there, and its source."""
    pick = []
    for claim, keys in CLAIMS.items():
        rank = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
        pick.append(F.min_by(F.struct("value", F.col("key").alias("source")), F.when(rank > 0, rank * 1_000_000 + F.col("ord"))).alias(claim))
    return facts.groupBy("file_id").agg(*pick, F.lit(False).alias("verified"))
