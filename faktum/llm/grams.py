"""Byte-gram tables: what each gram of up to `order` bytes is worth, with back-off.

A gram is the last bytes as a number, the latest byte lowest.  Two ways to fit
a table from counts by class:

* `kneser_ney`: the difference of two classes' interpolated Kneser-Ney
  log-probabilities.  At the full order a class's counts are those of its
  texts; at lower orders they are the numbers of distinct bytes that precede a
  gram, of the class and, with the weight `shared`, of both together, so an
  expression that one class has rarely shown is smoothed by what both have.
* `markov`: each class's log-probabilities from a variable-order Markov model,
  whose every order is smoothed by the next lower one (Dirichlet, weight tau).

Below order 1 lies the uniform distribution over bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from faktum.llm import textkit

U64 = np.uint64
DISCOUNT = 0.75


def byte_grams(buf: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(the gram at each byte, n + 1 places); white space is one kind, A-Z is a-z, a space stands before each text."""
    sizes = np.diff(offsets)
    at = np.concatenate([[0], np.cumsum(sizes + order - 1)])
    padded = np.full(int(at[-1]), 0x20, np.uint8)
    own = textkit.fold(buf)
    own[textkit.is_space(own)] = 0x20
    padded[np.arange(len(buf)) + np.repeat(at[:-1] + order - 1 - offsets[:-1], sizes)] = own
    out = np.zeros(max(0, len(padded) - order + 1), U64)
    for k in range(order):
        out |= padded[order - 1 - k : len(padded) - k].astype(U64) << U64(8 * k)
    keep = np.ones(len(padded), bool)
    keep[(at[:-1, None] + np.arange(order - 1)[None, :]).ravel()] = False
    return out[keep[order - 1 :]], np.concatenate([[0], np.cumsum(sizes)])


def tally(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums the rows of weights with equal keys; keys come out ascending."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    if not len(keys):
        return keys, weights
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights[order], first)


def low(order: int) -> np.uint64:
    return U64((1 << (8 * order)) - 1)


class _Slots:
    """Places of values among ascending distinct keys."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(6, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = U64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * U64(0x9E3779B97F4A7C15)) >> self.shift

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = self.slots[self._slot(keys)].astype(np.int64)
        found = self.keys[at] == keys
        rest = np.flatnonzero(~found)
        again = np.searchsorted(self.keys, keys[rest])
        again[again == len(self.keys)] = 0
        at[rest], found[rest] = again, self.keys[again] == keys[rest]
        return at, found


@dataclass
class Table:
    """keys[k], value[k]: seen grams of order k and their values (a column each).  contexts[k], step[k]: seen contexts of k bytes and what backing off from them adds.  floor: the value of a byte below order 1."""

    order: int
    keys: dict[int, np.ndarray]
    value: dict[int, np.ndarray]
    contexts: dict[int, np.ndarray]
    step: dict[int, np.ndarray]
    floor: float = 0.0
    _slots: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return self.__dict__ | {"_slots": None}

    def of(self, grams: np.ndarray) -> np.ndarray:
        """A row of values for each gram of the full order."""
        if self._slots is None:
            self._slots = ({k: _Slots(v) for k, v in self.keys.items()}, {k: _Slots(v) for k, v in self.contexts.items()})
        out = np.zeros((len(grams), self.value[1].shape[1]), np.float32)
        left, own = np.arange(len(grams)), grams
        for k in range(self.order, 0, -1):
            at, found = self._slots[0][k].find(own)
            out[left[found]] += self.value[k][at[found]]
            left, own = left[~found], own[~found]
            if not len(left):
                break
            at, found = self._slots[1][k - 1].find(own >> U64(8))
            out[left[found]] += self.step[k - 1][at[found]]
            own = own & low(k - 1)
        out[left] += self.floor
        return out

    def runs(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of the texts that aren't empty, their bytes' values one after the other, n + 1 places), run by run."""
        buf, offsets = textkit.utf8(texts)
        for lo, hi in textkit.runs(offsets):
            g, places = byte_grams(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], self.order)
            has = np.flatnonzero(np.diff(places))
            if len(has):
                yield lo + has, self.of(g).astype(np.float64), np.append(places[has], places[-1])

    def sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(sums of values over each whole text, bytes of each text)."""
        out = np.zeros((len(texts), self.value[1].shape[1]))
        for at, values, places in self.runs(texts):
            out[at] = np.add.reduceat(values, places[:-1])
        return out, np.diff(textkit.utf8(texts)[1])

    def greatest(self, texts: pa.Array, size: int) -> np.ndarray:
        """The greatest mean value of `size` bytes in a row (of a shorter text, its mean; 0 of an empty one), of a table with one column."""
        out = np.zeros(len(texts))
        for at, values, places in self.runs(texts):
            sums = np.concatenate([[0.0], np.cumsum(values[:, 0])])
            means = np.full(len(values), -np.inf)
            means[: max(0, len(values) - size + 1)] = (sums[size:] - sums[:-size]) / size
            late = (places[1:, None] - np.arange(1, size)[None, :]).ravel()  # passages that would run into the next text
            means[late[late >= 0]] = -np.inf
            best = np.maximum.reduceat(means, places[:-1])
            length = np.diff(places)
            short = length < size
            best[short] = (sums[places[1:]] - sums[places[:-1]])[short] / length[short]
            out[at] = best
        return out


def counts(texts: pa.Array, classes: np.ndarray, n_classes: int, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the full order with their counts in each class of texts."""
    buf, offsets = textkit.utf8(texts)
    parts = []
    for lo, hi in textkit.runs(offsets):
        g, places = byte_grams(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], order)
        own = np.repeat(classes[lo:hi], np.diff(places))
        for c in range(n_classes):
            keys, n = np.unique(g[own == c], return_counts=True)
            weights = np.zeros((len(keys), n_classes))
            weights[:, c] = n
            parts.append((keys, weights))
    if not parts:
        return np.zeros(0, U64), np.zeros((0, n_classes))
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def word_counts(texts: pa.Array, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words with the numbers of texts of each class that hold them."""
    buf, offsets = textkit.utf8(texts)
    parts = []
    for lo, hi in textkit.runs(offsets):
        h, at, _ = textkit.words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], textkit.NO_LETTER)
        order = np.lexsort((h, at))
        h, at = h[order], at[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (at[1:] != at[:-1])]) if len(h) else np.zeros(0, bool)
        h, own = h[new], classes[lo:hi][at[new]]
        weights = np.zeros((len(h), n_classes))
        weights[np.arange(len(h)), own] = 1
        parts.append(tally(h, weights))
    if not parts:
        return np.zeros(0, U64), np.zeros((0, n_classes))
    return tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


@dataclass
class Words:
    """Seen words, ascending, with log P(class 1) - log P(class 0) of each; `unseen` is that of any other."""

    keys: np.ndarray
    value: np.ndarray
    unseen: float

    def greatest(self, texts: pa.Array) -> np.ndarray:
        """The greatest value of each text's words; 0 without words."""
        out = np.zeros(len(texts))
        buf, offsets = textkit.utf8(texts)
        for lo, hi in textkit.runs(offsets):
            h, _, places = textkit.words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], textkit.NO_LETTER)
            if len(h) and len(self.keys):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                has = np.flatnonzero(np.diff(places))
                out[lo + has] = np.maximum.reduceat(np.where(self.keys[at] == h, self.value[at], self.unseen), places[has])
        return out


def words_kneser_ney(keys: np.ndarray, weights: np.ndarray, shared: float) -> Words:
    """weights: the numbers of texts of class 0 and class 1 that hold a word.

    A class's discounted counts are interpolated with how surely a word belongs to the class at all: once if it has
    it, `shared` times its count in both, and half a time whatever it is.
    """
    weights = np.vstack([weights, np.zeros((1, 2))])  # the last stands for any unseen word
    kinds, total = (weights > 0).sum(axis=0), np.maximum(weights.sum(axis=0), 1)
    lower = (weights > 0) + shared * weights.sum(axis=1, keepdims=True) + 0.5
    lower = lower / lower.sum(axis=0)
    p = np.maximum(weights - DISCOUNT, 0) / total + DISCOUNT * np.maximum(kinds, 1) / total * lower
    value = np.log(p[:, 1] / p[:, 0])
    return Words(keys, value[:-1], float(value[-1]))


def _spans(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first key of each context, each key's context number, contexts)."""
    context = keys >> U64(8)
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
    return first, np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys)))), context[first]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > 0)


def kneser_ney(keys: np.ndarray, weights: np.ndarray, order: int, shared: float) -> Table:
    """weights: counts in class 0 and class 1; the table's one column is log P(class 1) - log P(class 0)."""
    levels = {order: (keys, weights)}
    seen = (weights > 0).astype(float)
    for k in range(order - 1, 0, -1):
        above = levels[k + 1][0] & low(k)
        keys, before = tally(above, np.column_stack([seen, np.ones(len(above))]))
        levels[k] = (keys, before[:, :2] + shared * before[:, 2:])
        seen = (before[:, :2] > 0).astype(float)
    table = Table(order, {k: v[0] for k, v in levels.items()}, {}, {}, {})
    prob: dict[int, np.ndarray] = {}
    for k in range(1, order + 1):
        keys, own = levels[k]
        first, at, table.contexts[k - 1] = _spans(keys)
        left = np.maximum(own - DISCOUNT * np.minimum(own, 1), 0)
        total, mass = (np.add.reduceat(x, first) if len(keys) else x for x in (own, left))
        rest = np.maximum(np.where(total > 0, 1 - _ratio(mass, total), 1.0), 1e-9)
        lower = prob[k - 1][np.searchsorted(levels[k - 1][0], keys & low(k - 1))] if k > 1 else np.full(own.shape, 1 / 256)
        prob[k] = _ratio(left, total[at]) + rest[at] * lower
        table.value[k] = np.log(prob[k][:, 1:] / prob[k][:, :1]).astype(np.float32)
        table.step[k - 1] = np.log(rest[:, 1:] / rest[:, :1]).astype(np.float32)
    return table


def markov(keys: np.ndarray, weights: np.ndarray, order: int, tau: float) -> Table:
    """A column of natural log-probabilities for each column of counts."""
    levels = {order: (keys, weights)}
    for k in range(order - 1, 0, -1):
        levels[k] = tally(levels[k + 1][0] & low(k), levels[k + 1][1])
    table = Table(order, {k: v[0] for k, v in levels.items()}, {}, {}, {}, float(np.log(1 / 256)))
    prob: dict[int, np.ndarray] = {}
    for k in range(1, order + 1):
        keys, own = levels[k]
        first, at, table.contexts[k - 1] = _spans(keys)
        total = np.add.reduceat(own, first) if len(keys) else own
        lower = prob[k - 1][np.searchsorted(levels[k - 1][0], keys & low(k - 1))] if k > 1 else np.full(own.shape, 1 / 256)
        prob[k] = (own + tau * lower) / (total[at] + tau)
        table.value[k] = np.log(prob[k]).astype(np.float32)
        table.step[k - 1] = np.log(tau / (total + tau)).astype(np.float32)
    return table


#: A part of the counts: for each key and class that has one, the key, the class and the count, as bytes.
PART = pa.schema([("keys", pa.binary()), ("classes", pa.binary()), ("weights", pa.binary())])
PART_DDL = "keys binary, classes binary, weights binary"


def count_batches(n_classes: int, order: int, text: str = "text", label: str = "class"):
    """For mapInArrow over (text, class): the counts of each task's grams (order 0: of its words), as one row."""

    def run(batches):
        parts = []
        for batch in batches:
            classes = np.asarray(batch.column(label).to_pylist(), np.int64)
            parts.append(counts(batch.column(text), classes, n_classes, order) if order else word_counts(batch.column(text), classes, n_classes))
        if parts:
            keys, weights = tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            at, own = np.nonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in (keys[at], own.astype("<u2"), weights[at, own].astype("<u4"))], schema=PART)

    return run


def gather(rows, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """The sum of all parts."""
    parts = [tuple(np.frombuffer(x[c], kind) for c, kind in (("keys", U64), ("classes", "<u2"), ("weights", "<u4"))) for x in rows]
    if not parts:
        return np.zeros(0, U64), np.zeros((0, n_classes))
    keys = np.unique(np.concatenate([p[0] for p in parts]))
    weights = np.zeros((len(keys), n_classes))
    for own, classes, n in parts:
        weights[np.searchsorted(keys, own), classes] += n
    return keys, weights
