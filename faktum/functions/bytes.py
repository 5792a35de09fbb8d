"""Byte statistics.  The histogram of a value is one numpy pass over its Arrow buffer."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a window, how far below the peak a window still belongs to it, spans reported at most.
WINDOW, TOLERANCE, SPANS = 1024, 0.5, 64


def shannon(counts: np.ndarray) -> float:
    """Bits a byte; 0 for nothing."""
    n = counts.sum()
    if not n:
        return 0.0
    p = counts[counts > 0] / n
    return float(-(p * np.log2(p)).sum()) + 0.0


def histogram(data: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(data, np.uint8), minlength=256)


_BLANK = [9, 10, 13, 32]
_ODD = np.array([(b < 32 and b not in (9, 10, 13)) or b == 127 for b in range(256)])


#: Values, and bytes, whose histograms are made at once.
TOGETHER, STEP = 2048, 1 << 20


def flat(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes of a column, where each value begins, and the last ends) as they lie in Arrow's buffers; null counts as empty."""
    values = pc.fill_null(values.cast(pa.large_binary()), b"")
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = values.buffers()
    return np.frombuffer(data or b"", np.uint8), np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]


def histograms(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray | None = None):
    """(first, counts) for stretches of pieces raw[start:end], pieces in order and apart: a row of 256 counts for each.

    By default a piece ends where the next begins.  A stretch has up to TOGETHER pieces and STEP bytes; a longer piece is
    a stretch of its own, counted STEP bytes at a time.
    """
    starts, ends = (starts[:-1], starts[1:]) if ends is None else (starts, ends)
    before = np.concatenate([[0], np.cumsum(ends - starts)])
    k = 0
    while k < len(starts):
        to = min(k + TOGETHER, max(k + 1, int(np.searchsorted(before, before[k] + STEP, "right")) - 1))
        if to == k + 1:
            h = np.zeros((1, 256), np.int64)
            for at in range(int(starts[k]), int(ends[k]), STEP):
                h += np.bincount(raw[at : min(at + STEP, int(ends[k]))], minlength=256)
        else:
            sizes = ends[k:to] - starts[k:to]
            own = raw[starts[k] : ends[to - 1]] if before[to] - before[k] == ends[to - 1] - starts[k] else raw[np.repeat(starts[k:to] - (before[k:to] - before[k]), sizes) + np.arange(before[to] - before[k])]
            h = np.bincount(np.repeat(np.arange(to - k) * 256, sizes) + own, minlength=256 * (to - k)).reshape(-1, 256)
        yield k, h
        k = to


def entropies(h: np.ndarray) -> np.ndarray:
    """Bits a byte of each row of counts; 0 for nothing."""
    row, byte = np.nonzero(h)
    p = h[row, byte] / np.maximum(h.sum(axis=1), 1)[row]
    return np.bincount(row, weights=-p * np.log2(p), minlength=len(h)) + 0.0


def in_stretches(values: pa.Array, f) -> pa.Array:
    """f of a column, a stretch of up to STEP bytes (one value at least) at a time."""
    offsets = flat(values)[1]
    out, k = [f(values.slice(0, 0))], 0
    while k < len(values):
        to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + STEP, "right")) - 1)
        out.append(f(values.slice(k, to - k)))
        k = to
    return pa.concat_arrays(out)


def listed(sizes: np.ndarray, **fields) -> pa.Array:
    """Arrays of structs from the flat values of their fields and the sizes of the arrays."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in fields.values()], list(fields)))


_FACT_TYPES = {"entropy": pa.float64(), "kinds": pa.int64(), "common": pa.int32(), "common_count": pa.int64(), "high": pa.int64(), "odd": pa.int64(), "zeros": pa.int64()}


def _facts(values: pa.Array) -> pa.Array:
    parts = [np.zeros((0, 7))]
    for _, h in histograms(*flat(values)):
        shown = h.copy()
        shown[:, _BLANK] = 0
        top = 255 - np.argmax(shown[:, ::-1], axis=1)
        count = shown[np.arange(len(h)), top]
        parts.append(np.column_stack([entropies(h), (h > 0).sum(axis=1), np.where(count > 0, top, -1), count, h[:, 128:].sum(axis=1), h[:, _ODD].sum(axis=1), h[:, 0]]))
    own = np.concatenate(parts)
    return pa.StructArray.from_arrays([pa.array(own[:, k] if t == pa.float64() else own[:, k].astype(np.int64), t) for k, t in enumerate(_FACT_TYPES.values())], list(_FACT_TYPES))


_HEX = pa.array([f"{b:02X}" for b in range(256)])


def _byte_counts(values: pa.Array) -> pa.Array:
    sizes, bytes_, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for _, h in histograms(*flat(values)):
        row, byte = np.nonzero(h)
        sizes.append(np.bincount(row, minlength=len(h)))
        bytes_.append(byte)
        n.append(h[row, byte])
    return listed(np.concatenate(sizes), byte_hex=_HEX.take(pa.array(np.concatenate(bytes_))), n=np.concatenate(n))


def byte_counts(content: Column) -> Column:
    """Each byte that occurs, in hex, with its count."""
    return F.arrow_udf(_byte_counts, "array<struct<byte_hex:string,n:bigint>>")(content)


def byte_facts(content: Column) -> Column:
    """entropy, kinds, common (the commonest byte but blanks, the highest of equals, -1 for none), common_count, high, odd, zeros."""
    return F.arrow_udf(_facts, "entropy double, kinds long, common int, common_count long, high long, odd long, zeros long")(content)


def _entropies(values: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0), *(entropies(h) for _, h in histograms(*flat(values)))]))


def byte_entropy(content: Column) -> Column:
    """The entropy alone."""
    return F.arrow_udf(_entropies, "double")(content)


def windowed(data: bytes) -> tuple[float, float, int, int, list[tuple[int, int]]]:
    """(overall entropy, peak window's entropy, bytes in peak regions, offset of the largest, spans by size)."""
    n = len(data)
    if not n:
        return 0.0, 0.0, 0, 0, []
    raw = np.frombuffer(data, np.uint8)
    k = -(-n // WINDOW)
    counts = np.bincount(np.repeat(np.arange(k), WINDOW)[:n] * 256 + raw, minlength=k * 256).reshape(k, 256)
    levels = np.array([shannon(c) for c in counts])
    high = np.concatenate([[False], levels >= levels.max() - TOLERANCE, [False]])
    edges = np.flatnonzero(high[1:] != high[:-1]).reshape(-1, 2)
    runs = [(int(a) * WINDOW, min(int(b) * WINDOW, n) - int(a) * WINDOW) for a, b in edges]
    by_size = sorted(runs, key=lambda r: -r[1])
    return shannon(counts.sum(axis=0)), float(levels.max()), sum(r[1] for r in runs), by_size[0][0], by_size[:SPANS]


def _windows(values: pa.Array) -> pa.Array:
    """The same for a column at once: windows of all values are counted in stretches, and levels have 9 digits, so that the order of sums doesn't show."""
    raw, offsets = flat(values)
    n = np.diff(offsets)
    k = -(-n // WINDOW)
    overall = np.concatenate([np.zeros(0), *(entropies(h) for _, h in histograms(raw, offsets))])
    of = np.repeat(np.arange(len(n)), k)  # the value of each window
    first = np.concatenate([[0], np.cumsum(k)])
    start = (np.arange(len(of)) - first[of]) * WINDOW
    size = np.minimum(WINDOW, n[of] - start)
    levels = np.concatenate([np.zeros(0), *(entropies(h) for _, h in histograms(raw, offsets[of] + start, offsets[of] + start + size))])
    some = np.flatnonzero(k)
    peak = np.zeros(len(n))
    peak[some] = np.maximum.reduceat(levels, first[some]) if len(some) else 0.0
    high = np.flatnonzero(np.round(levels, 9) >= np.round(peak[of] - TOLERANCE, 9))
    new = np.concatenate([[True], (np.diff(high) > 1) | (np.diff(of[high]) > 0)])[: len(high)]
    run = np.flatnonzero(new)
    value, offset = of[high[run]], start[high[run]]
    size = np.add.reduceat(size[high], run) if len(run) else size[:0]
    order = np.lexsort((offset, -size, value))
    value, offset, size = value[order], offset[order], size[order]
    most = np.flatnonzero(np.diff(value, prepend=-1))  # of each value that has bytes, its largest run
    peak_bytes, peak_offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    np.add.at(peak_bytes, value, size)
    peak_offset[value[most]] = offset[most]
    shown = np.arange(len(value)) - np.repeat(most, np.diff(np.append(most, len(value)))) < SPANS
    spans = listed(np.bincount(value[shown], minlength=len(n)), offset=offset[shown].astype(np.int64), len=size[shown].astype(np.int64))
    return pa.StructArray.from_arrays([pa.array(overall), pa.array(peak), pa.array(peak_bytes), pa.array(peak_offset), spans], ["overall", "peak", "peak_bytes", "peak_offset", "spans"])


def window_facts(content: Column) -> Column:
    return F.arrow_udf(_windows, "overall double, peak double, peak_bytes long, peak_offset long, spans array<struct<offset:bigint,len:bigint>>")(content)


def printable_strings(content: Column, least: int = 4) -> Column:
    """Runs of printable ASCII and tabs of at least `least` bytes."""
    return F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"[\x20-\x7e\t]{{{least},}}"), F.lit(0))


def wide_strings(content: Column, least: int = 4) -> Column:
    """Runs of printable ASCII in UTF-16, little endian, without the zero bytes."""
    found = F.regexp_extract_all(F.decode(content, "ISO-8859-1"), F.lit(rf"(?:[\x20-\x7e\t]\x00){{{least},}}"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, "\\x00", ""))


def packer_version(content: Column) -> Column:
    """The version that the UPX packer leaves, '' if only its mark is there, null without."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(text.contains("UPX!"), F.regexp_extract(text, r"\$Id: UPX ([0-9]+\.[0-9]+)", 1))


def home_path(content: Column) -> Column:
    """The first token with /Users/, /home/ or C:\\Users\\."""
    return F.nullif(F.regexp_extract(F.decode(content, "ISO-8859-1"), r"(?:/Users/|/home/|C:\\Users\\)[^\x00-\x20\"'<>|:*?]+", 0), F.lit(""))


def xor_gate(text: Column) -> Column:
    """Whether a source is worth a search for xor-encoded strings."""
    return text.contains("^") | F.lower(text).contains("xor")
