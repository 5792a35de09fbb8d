"""Vectorised text kernels shared by the corpus operators.

Everything works on the UTF-8 buffer of an Arrow string column, so no Python
string object is made per row.  A null text counts as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Texts are handled in runs of about this many bytes, which bounds the memory of a task.
CHUNK_BYTES = 1 << 20

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: All but ASCII letters and digits and the bytes of other characters.
NO_LETTER = np.array([x < 128 and not chr(x).isalnum() for x in range(256)])


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """For mapInArrow: trims after each task, as Python workers live on for the next ones."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_BASE = 0x9E3779B97F4A7C15
_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD1342543DE82EF95)) | U64(1)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, U64), np.ones(1, U64))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, for n + 1 places."""
    global _powers
    if len(_powers[0]) < n + 1:
        size = max(n + 1, 2 * CHUNK_BYTES)
        out = []
        for base in (_BASE, _inverse(_BASE)):
            steps = np.full(size, base, dtype=U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers = (out[0], out[1])
    return _powers


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_utf8())
    column = column.cast(pa.large_utf8())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, raw_offsets, data = column.buffers()
    offsets = np.frombuffer(raw_offsets, np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return buf, offsets - offsets[0]


def runs(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer text is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def fold(buf: np.ndarray) -> np.ndarray:
    """Lower-case A-Z only."""
    return _FOLD[buf]


def is_space(buf: np.ndarray) -> np.ndarray:
    return _SPACE[buf]


def words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hash, text number and bounds of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased (`gap`: what else stands between words).

    Returns (hash, text, first word of each text as n + 1 places).
    """
    n = len(offsets) - 1
    hashes, owner = [], []
    for lo, hi in runs(offsets):
        a, b = int(offsets[lo]), int(offsets[hi])
        for s, e in _pieces(buf, a, b, hi - lo == 1, gap):
            h, at = _words(buf[s:e], np.clip(offsets[lo : hi + 1] - s, 0, e - s), gap)
            hashes.append(h)
            owner.append(at + lo)
    if not hashes:
        return np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    h, at = np.concatenate(hashes), np.concatenate(owner)
    return h, at, np.searchsorted(at, np.arange(n + 1))


def _pieces(buf: np.ndarray, a: int, b: int, alone: bool, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts a very long text at white space, so that its arrays stay small."""
    while alone and b - a > 4 * CHUNK_BYTES:
        cut = a + CHUNK_BYTES
        while cut < b:
            free = np.flatnonzero(gap[buf[cut : min(b, cut + 65536)]])
            if len(free):
                cut += int(free[0])
                break
            cut = min(b, cut + 65536)
        yield a, cut
        a = cut
    if b > a:
        yield a, b


def _words(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = len(buf)
    if size == 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    solid = ~gap[buf]
    before = np.empty(size, bool)
    before[0] = False
    before[1:] = solid[:-1]
    first = offsets[:-1][offsets[1:] > offsets[:-1]]
    before[first] = False
    starts = np.flatnonzero(solid & ~before)
    if not len(starts):
        return np.zeros(0, U64), np.zeros(0, np.int64)
    after = np.empty(size, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[first[1:] - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    power, inverse = _power_tables(size)
    sums = np.empty(size + 1, U64)
    sums[0] = 0
    np.cumsum(_BYTE[_FOLD[buf]] * power[:size], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h = mix64(h ^ ((ends - starts).astype(U64) * U64(0xA24BAED4963EE407)))
    return h, np.searchsorted(offsets, starts, "right") - 1


def shingles(h: np.ndarray, at: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text: (values sorted within a text, n + 1 places).

    A text of fewer words than `width` has its whole sequence as its one shingle; one without words has none.
    """
    n = len(first) - 1
    count = np.diff(first)
    if not len(h):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    rolled = np.zeros(len(h), U64)
    for k in range(width):
        step = U64(pow(0xC2B2AE3D27D4EB4F, width - k, 1 << 64))
        rolled[: len(h) - k] += h[k:] * step
    rolled = mix64(rolled)
    place = np.arange(len(h)) - first[at]
    full = place <= (count[at] - width)
    short = np.flatnonzero((count > 0) & (count < width))
    value, owner = rolled[full], at[full]
    if len(short):
        extra = np.zeros(len(short), U64)
        for k in range(width - 1):
            has = count[short] > k
            step = U64(pow(0x9FB21C651E98DF25, k + 1, 1 << 64))
            extra[has] += h[first[short[has]] + k] * step
        extra = mix64(extra + count[short].astype(U64))
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        value, owner = value[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    kept, sizes = [], np.zeros(n + 1, np.int64)
    for i in range(n):
        if bounds[i] < bounds[i + 1]:
            own = np.unique(value[bounds[i] : bounds[i + 1]])
            kept.append(own)
            sizes[i + 1] = len(own)
    return (np.concatenate(kept) if kept else np.zeros(0, U64)), np.cumsum(sizes)


def located(buf: np.ndarray, offsets: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As `words`, with the first byte of each word and the one after its last: (hash, text, start, end)."""
    out = []
    for s, e in _pieces(buf, int(offsets[0]), int(offsets[-1]), True, gap):
        own = np.clip(offsets - s, 0, e - s)
        solid = ~gap[buf[s:e]]
        edge = np.zeros(e - s + 1, bool)
        edge[own] = True  # a text's end parts words too
        turn = np.flatnonzero(np.concatenate([solid[:1], solid[1:] != solid[:-1], [True]]) | edge)
        first = turn[:-1][solid[turn[:-1]]]
        last = turn[1:][solid[turn[:-1]]]
        power, inverse = _power_tables(e - s)
        sums = np.zeros(e - s + 1, U64)
        np.cumsum(_BYTE[_FOLD[buf[s:e]]] * power[: e - s], out=sums[1:])
        h = mix64((sums[last] - sums[first]) * inverse[first] ^ ((last - first).astype(U64) * U64(0xA24BAED4963EE407)))
        out.append((h, first + s, last + s))
    if not out:
        return np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    h, first, last = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, np.searchsorted(offsets, first, "right") - 1, first, last
