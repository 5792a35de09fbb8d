"""Members of archives, one row each, by an Arrow pass over whole files.

Nothing is unpacked to disk.  A file that can't be read gives no members and
one error row; it never fails its task.
"""

from __future__ import annotations

import calendar
import io
import struct
import tarfile
import zipfile
import zlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that are inflated, at most, to tell an npm package and a Python sdist (whose PKG-INFO often comes last), and members of a tar that are looked at for an image.
NPM_BYTES = 8 << 20
SDIST_BYTES = 64 << 20
OCI_MEMBERS = 512

MEMBERS = pa.schema(
    [("file_id", pa.string()), ("ord", pa.int64()), ("path", pa.string()), ("size_bytes", pa.int64()), ("compressed_bytes", pa.int64()), ("entry_type", pa.string()), ("method", pa.string()), ("mode", pa.int64()), ("mtime_unix", pa.int64())]
    + [("crc32", pa.int64()), ("encrypted", pa.bool_()), ("extra_bytes", pa.int64()), ("comment_bytes", pa.int64()), ("linkname", pa.string()), ("uname", pa.string()), ("gname", pa.string()), ("offset", pa.int64()), ("error", pa.string())]
)
MEMBERS_DDL = (
    "file_id string, ord long, path string, size_bytes long, compressed_bytes long, entry_type string, method string, mode long, mtime_unix long, crc32 long, encrypted boolean, extra_bytes long, comment_bytes long, "
    "linkname string, uname string, gname string, offset long, error string"
)
#: Names of compression methods and entry types.
METHODS = {0: "stored", 8: "deflate", 9: "deflate64", 12: "bzip2", 14: "lzma", 93: "zstd", 95: "xz", 99: "aes"}
TYPES = {b"0": "file", b"\0": "file", b"1": "hardlink", b"2": "symlink", b"3": "char-device", b"4": "block-device", b"5": "directory", b"6": "fifo", b"7": "contiguous"}


def _zip(data: bytes) -> list[dict]:
    out = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i in z.infolist():
            mode = i.external_attr >> 16 if i.create_system == 3 else None
            link = mode is not None and mode & 0o170000 == 0o120000
            time = calendar.timegm((*i.date_time, 0, 0, 0)) if i.date_time > (1980, 1, 1, 0, 0, 0) and 1 <= i.date_time[1] <= 12 and 1 <= i.date_time[2] <= 31 else None
            out.append(
                {"path": i.filename, "size_bytes": i.file_size, "compressed_bytes": i.compress_size, "entry_type": "directory" if i.is_dir() else "symlink" if link else "file", "method": METHODS.get(i.compress_type, f"method-{i.compress_type}"), "mode": mode and mode & 0o7777}
                | {"mtime_unix": time, "crc32": i.CRC, "encrypted": bool(i.flag_bits & 1), "extra_bytes": len(i.extra), "comment_bytes": len(i.comment), "offset": i.header_offset}
            )
    return out


def _layout(data: bytes) -> tuple[int, int, int, int, int]:
    """(comment's bytes, whether it has one, whether ZIP64 is used, bytes before the first member, bytes after the end record) of a ZIP."""
    first, end = data.find(b"PK\x03\x04"), data.rfind(b"PK\x05\x06")
    if end < 0 or end + 22 > len(data):
        return 0, 0, 0, max(first, 0), 0
    count, size, start, comment = struct.unpack_from("<HIIH", data, end + 10)
    wide = count == 0xFFFF or 0xFFFFFFFF in (size, start)
    at = end - size  # of the directory, also where something stands before the archive
    while not wide and 0 <= at <= end - 46 and data[at : at + 4] == b"PK\x01\x02":
        packed, full = struct.unpack_from("<II", data, at + 20)
        name, extra, note = struct.unpack_from("<HHH", data, at + 28)
        tags, k = data[at + 46 + name : at + 46 + name + extra], 0
        while k + 4 <= len(tags) and not wide:
            tag, n = struct.unpack_from("<HH", tags, k)
            wide, k = tag == 1, k + 4 + n
        wide = wide or 0xFFFFFFFF in (packed, full)
        at += 46 + name + extra + note
    return comment, int(comment > 0), int(wide), max(first, 0), max(0, len(data) - end - 22 - comment)


def zip_layout(content: Column) -> Column:
    """comment_size, has_comment, uses_zip64, prefix_bytes, trailing_bytes of a ZIP's bytes."""
    names = ["comment_size", "has_comment", "uses_zip64", "prefix_bytes", "trailing_bytes"]
    run = lambda values: pd.DataFrame([_layout(x or b"") for x in values], columns=names)
    return F.pandas_udf(run, ", ".join(f"{x} long" for x in names))(content)


def _tar(data: bytes) -> list[dict]:
    out = []
    with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
        for i in t:
            out.append(
                {"path": i.name, "size_bytes": i.size, "compressed_bytes": i.size, "entry_type": TYPES.get(i.type, "other"), "method": "stored", "mode": i.mode & 0o7777, "mtime_unix": int(i.mtime) or None}
                | {"encrypted": False, "extra_bytes": 0, "comment_bytes": 0, "linkname": i.linkname or None, "uname": i.uname or None, "gname": i.gname or None, "offset": i.offset}
            )
    return out


def _ar(data: bytes) -> list[dict]:
    out, at = [], 8
    while at + 60 <= len(data):
        head = data[at : at + 60]
        if head[58:60] != b"`\n":
            raise ValueError("bad member header")
        number = lambda a, b, base=10: int(head[a:b].strip() or b"0", base)
        size = number(48, 58)
        out.append({"path": head[:16].decode("latin-1").rstrip().rstrip("/"), "size_bytes": size, "compressed_bytes": size, "entry_type": "file", "method": "stored", "mode": number(40, 48, 8) & 0o7777, "mtime_unix": number(16, 28) or None, "encrypted": False, "extra_bytes": 0, "comment_bytes": 0, "offset": at})
        at += 60 + size + size % 2
    return out


def _asar(data: bytes) -> list[dict]:
    import json

    size = struct.unpack_from("<I", data, 12)[0]
    out: list[dict] = []

    def walk(node: dict, prefix: str) -> None:
        for name, x in node.get("files", {}).items():
            inner = "files" in x
            out.append({"path": prefix + name + "/" * inner, "size_bytes": int(x.get("size", 0)), "compressed_bytes": int(x.get("size", 0)), "entry_type": "directory" if inner else "symlink" if "link" in x else "file", "method": "stored", "mode": 0o755 if x.get("executable") else None, "encrypted": False, "extra_bytes": 0, "comment_bytes": 0, "linkname": x.get("link")})
            if inner:
                walk(x, prefix + name + "/")

    walk(json.loads(data[16 : 16 + size]), "")
    return out


READERS = {"zip": _zip, "tar": _tar, "ar": _ar, "asar": _asar}


def members_of(data: bytes, archive_format: str) -> list[dict]:
    try:
        return [x | {"ord": k} for k, x in enumerate(READERS[archive_format](data))]
    except Exception as e:  # hostile input is data
        return [{"ord": -1, "error": f"{archive_format}-parse: {e}"[:500]}]


def _run(batches):
    for batch in batches:
        rows = []
        for file_id, kind, data in zip(batch.column("file_id").to_pylist(), batch.column("archive_format").to_pylist(), batch.column("content"), strict=True):
            rows += [dict.fromkeys(MEMBERS.names) | {"file_id": file_id} | x for x in members_of(data.as_py() or b"", kind)]
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS)
                rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS)


def members(files: DataFrame) -> DataFrame:
    """files: (file_id, archive_format, content).  Kinds without a reader, and compressed tars, give no rows."""
    rows = files.filter(F.col("archive_format").isin(list(READERS))).select("file_id", "archive_format", "content")
    return rows.mapInArrow(_run, MEMBERS_DDL)


# what lies inside compressed streams


class Limit(Exception):
    """More was asked for than is inflated."""


class Inflated(io.RawIOBase):
    """A gzip stream's bytes as they are asked for, never held as a whole; past `limit` a read fails."""

    def __init__(self, data: bytes, limit: int | None = None):
        self.data, self.at, self.given, self.limit = memoryview(data), 0, 0, limit
        self.inner = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        if self.limit is not None and self.given >= self.limit:
            raise Limit(f"more than {self.limit} bytes")
        most = len(into) if self.limit is None else min(len(into), self.limit - self.given)
        while not self.inner.eof:
            rest = self.inner.unconsumed_tail
            if not rest:
                rest = self.data[self.at : self.at + 65536]
                self.at += len(rest)
            out = self.inner.decompress(rest, most)
            if out:
                into[: len(out)] = out
                self.given += len(out)
                return len(out)
            if not len(rest):
                raise EOFError("stream ends early")
            if self.inner.eof and self.inner.unused_data[:2] == b"\x1f\x8b":
                self.at -= len(self.inner.unused_data)
                self.inner = zlib.decompressobj(31)
        return 0


def _gzip_kind(data: bytes) -> str | None:
    """npm: every member below package/, with its manifest; sdist: one root with a PKG-INFO below it, wherever that comes."""
    stream = Inflated(data, SDIST_BYTES)
    roots: set[str] = set()
    manifest = info = False
    small = True  # all members so far end within NPM_BYTES
    try:
        with tarfile.open(fileobj=io.BufferedReader(stream), mode="r|") as t:
            for m in t:
                name = m.name.removeprefix("./").rstrip("/")
                base = name.split("/")[-1]
                if base.startswith("._") or not name:
                    continue
                small = small and m.offset_data <= NPM_BYTES
                roots.add(name.split("/")[0])
                if len(roots) > 1:
                    return None
                manifest |= small and name == "package/package.json"
                info |= base == "PKG-INFO" and name.count("/") == 1
                if info and roots != {"package"}:
                    return "python_sdist"
                t.members = []  # headers that are done aren't kept
    except (Limit, tarfile.TarError, EOFError, zlib.error):  # cut off, or damaged: what was seen counts
        pass
    if manifest:
        return "npm"
    return "python_sdist" if info else None


def peek_type(path: str, data: bytes) -> str | None:
    """npm, python_sdist, oci_image, pkg_freebsd or pkg_arch, if the inside says so."""
    try:
        name = (path or "").lower()
        if data[:2] == b"\x1f\x8b":
            return None if name.endswith((".apk", ".crate", ".pkg.tar.gz")) else _gzip_kind(data)
        if data[:4] == b"\x28\xb5\x2f\xfd":
            import zstandard

            stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))
            if b"+MANIFEST" in stream.read(32):
                return "pkg_freebsd"
            if not name.endswith(".pkg.tar.zst"):
                return None
            stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data))
            with tarfile.open(fileobj=stream, mode="r|") as t:
                return "pkg_arch" if any(m.name.removeprefix("./") == ".PKGINFO" for m, _ in zip(t, range(8), strict=False)) else None
        if data[257:262] != b"ustar" or name.endswith((".apk", ".crate", ".pkg.tar.gz")):
            return None
        names = set()
        try:
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:") as t:
                for m, _ in zip(t, range(OCI_MEMBERS), strict=False):
                    names.add(m.name.removeprefix("./"))
        except tarfile.TarError:  # damaged: what was seen counts
            pass
        return "oci_image" if {"oci-layout", "index.json"} <= names or ("manifest.json" in names and any(n.endswith("layer.tar") or n.startswith("blobs/") for n in names)) else None
    except Exception:  # hostile input is data
        return None


def peek(path, content):
    """Only gzip, zstd and tar rows are looked into."""
    def look(paths: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([peek_type(p, d) if d is not None else None for p, d in zip(paths, data, strict=True)], dtype=object)

    starts = F.hex(F.substring(content, 1, 4))
    likely = starts.startswith("1F8B") | (starts == "28B52FFD") | (F.decode(F.substring(content, 258, 5), "ISO-8859-1") == "ustar")
    return F.when(likely, F.pandas_udf(look, "string")(path, F.when(likely, content)))
