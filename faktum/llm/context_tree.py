"""Context-tree weighting over bytes, one binary tree family per bit of a byte.

A symbol is a byte, written as eight binary decisions; the decision reached by
the bits p so far has its own context tree, whose nodes are (context bytes,
p).  A node holds the counts (a, b) of zeros and ones seen there, its
Krichevsky-Trofimov block probability Pe, and the weighted probability
Pw = Pe/2 + product of the children's Pw / 2 (Pw = Pe at the greatest depth).
All of it is computed from final training counts, so counts can be added up in
any order on any number of machines; a text is then scored with frozen counts
by the predictive mixture over all depths.  A path ends at the deepest context
that training has seen; it never falls off into an unseen node.

A gram is a uint64: the depth's context bytes, latest first, then the symbol.
A node key is the same with the bit prefix 1..255 in place of the symbol.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
END = 0xFF
START = 0x0A
_LOG_HALF = float(np.log(0.5))
_HALF_LOG_PI = 0.5 * float(np.log(np.pi))


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov block probability of a zeros and b ones."""
    return _log_gamma(a + 0.5) + _log_gamma(b + 0.5) - _log_gamma(a + b + 1.0) - 2 * _HALF_LOG_PI


def grams(buf: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The gram at each byte of each text and at its end: (grams, n + 1 places).

    Before its first byte a text has newlines; after its last comes END, which UTF-8 never holds.
    """
    n = len(offsets) - 1
    sizes = np.diff(offsets)
    wide = depth + sizes + 1
    at = np.concatenate([[0], np.cumsum(wide)])
    padded = np.full(int(at[-1]), START, np.uint8)
    shift = np.repeat(at[:-1] + depth - offsets[:-1], sizes)
    padded[np.arange(len(buf)) + shift] = buf
    padded[at[1:] - 1] = END
    out = padded[depth:].astype(U64)
    size = len(padded)
    for k in range(1, depth + 1):
        out |= padded[depth - k : size - k].astype(U64) << U64(8 * (depth + 1 - k))
    keep = np.ones(size, bool)
    head = (at[:-1, None] + np.arange(depth)[None, :]).ravel()
    keep[head] = False
    return out[keep[depth:]], np.concatenate([[0], np.cumsum(sizes + 1)])


def tally(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums the weights of equal keys; keys come out ascending."""
    if not len(keys):
        return keys, *weights
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(w[order], first) for w in weights)


class Tree:
    """The nodes of depths root..depth under grams that share no context with other trees' at the root depth."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int, root: int):
        self.depth, self.root = depth, root
        symbol = keys & U64(255)
        context = keys & ~U64(255)
        node, zero, one = [], [], []
        counts = counts.astype(np.float64)
        for j in range(8):
            bit = ((symbol >> U64(7 - j)) & U64(1)).astype(bool)
            node.append(context | U64(1 << j) | (symbol >> U64(8 - j)))
            zero.append(np.where(bit, 0.0, counts))
            one.append(np.where(bit, counts, 0.0))
        level = tally(np.concatenate(node), np.concatenate(zero), np.concatenate(one)) if len(keys) else (keys, counts, counts)
        self.nodes: dict[int, np.ndarray] = {}
        self.zeros: dict[int, np.ndarray] = {}
        self.ones: dict[int, np.ndarray] = {}
        self.parent: dict[int, np.ndarray] = {}
        self.log_pw: dict[int, np.ndarray] = {}
        self.stop: dict[int, np.ndarray] = {}
        self.nodes[depth], self.zeros[depth], self.ones[depth] = level
        self.log_pw[depth] = log_kt(level[1], level[2])
        self.stop[depth] = np.ones(len(level[0]))
        for d in range(depth - 1, root - 1, -1):
            self._above(d)

    def _above(self, d: int, a: np.ndarray | None = None) -> None:
        below = shorter(self.nodes[d + 1])
        self.nodes[d], self.parent[d + 1] = np.unique(below, return_inverse=True)
        n = len(self.nodes[d])
        up = lambda x: np.bincount(self.parent[d + 1], weights=x, minlength=n)
        self.zeros[d], self.ones[d] = up(self.zeros[d + 1]), up(self.ones[d + 1])
        self.log_pw[d], self.stop[d] = weigh(self.zeros[d], self.ones[d], up(self.log_pw[d + 1]))

    def spread(self, acc: np.ndarray, rest: np.ndarray) -> None:
        """From (sum so far, weight left) of the root depth's nodes to the predictive probability of a one at every node."""
        self.final: dict[int, np.ndarray] = {}
        for d in range(self.root, self.depth + 1):
            kt = (self.ones[d] + 0.5) / (self.zeros[d] + self.ones[d] + 1.0)
            self.final[d] = acc + rest * kt
            if d < self.depth:
                acc = (acc + rest * self.stop[d] * kt)[self.parent[d + 1]]
                rest = (rest * (1 - self.stop[d]))[self.parent[d + 1]]

    def log2(self, keys: np.ndarray, above: dict[int, np.ndarray]) -> np.ndarray:
        """log2 of the probability of each gram's symbol; `above` has dense tables for the depths under the root's."""
        out = np.zeros(len(keys))
        symbol, context = keys & U64(255), keys & ~U64(255)
        for j in range(8):
            node = context | U64(1 << j) | (symbol >> U64(8 - j))
            one = np.full(len(keys), np.nan)
            left = np.arange(len(keys))
            for d in range(self.depth, self.root - 1, -1):
                at = np.searchsorted(self.nodes[d], node[left])
                at[at == len(self.nodes[d])] = 0
                found = (self.nodes[d][at] == node[left]) if len(self.nodes[d]) else np.zeros(len(left), bool)
                one[left[found]] = self.final[d][at[found]]
                left, node = left[~found], shorter(node)
                if not len(left):
                    break
            for d in range(self.root - 1, -1, -1):
                if not len(left):
                    break
                value = above[d][node[left].astype(np.int64)]
                found = ~np.isnan(value)
                one[left[found]] = value[found]
                left, node = left[~found], shorter(node)
            one[left] = 0.5
            bit = ((symbol >> U64(7 - j)) & U64(1)).astype(bool)
            out += np.log2(np.where(bit, one, 1 - one))
        return out


def shorter(nodes: np.ndarray) -> np.ndarray:
    """The node keys with the oldest context byte left out."""
    return ((nodes >> U64(16)) << U64(8)) | (nodes & U64(255))


def weigh(a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log Pw, weight of stopping here) from counts and the sum of the children's log Pw."""
    pe = log_kt(a, b)
    pw = _LOG_HALF + np.logaddexp(pe, children)
    return pw, np.exp(_LOG_HALF + pe - pw)


def top(node: np.ndarray, a: np.ndarray, b: np.ndarray, children: np.ndarray) -> tuple[dict[int, np.ndarray], np.ndarray, np.ndarray]:
    """Depths 0 and 1 from the sums over depth 2: dense predictive tables by depth, and (sum so far, weight left) for depth 2.

    node: (latest byte, prefix) keys, at most 65,280 of them.
    """
    pw1, stop1 = weigh(a, b, children)
    root = (node & 255).astype(np.int64)
    up = lambda x: np.bincount(root, weights=x, minlength=256)
    a0, b0, c0 = up(a), up(b), up(pw1)
    _, stop0 = weigh(a0, b0, c0)
    kt0, kt1 = (b0 + 0.5) / (a0 + b0 + 1.0), (b + 0.5) / (a + b + 1.0)
    acc1, rest1 = (stop0 * kt0)[root], (1 - stop0)[root]
    final0 = np.where(a0 + b0 > 0, kt0, np.nan)
    at = node.astype(np.int64)
    tables = []
    for value in (acc1 + rest1 * kt1, acc1 + rest1 * stop1 * kt1, rest1 * (1 - stop1)):
        t = np.full(65536, np.nan)
        t[at] = value
        tables.append(t)
    return {0: final0, 1: tables[0]}, tables[1], tables[2]
