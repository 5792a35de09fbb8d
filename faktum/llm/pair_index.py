"""BPE by an index of pair occurrences, and its exact inverse.

The distinct words of a batch lie one after the other in one array of symbols.
The index maps the rank of each mergeable pair to all its positions in the
batch; ranks are applied in ascending order, a rank at all its positions at
once, and the lists of the pairs to the left and right of a merge are updated.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm.byte_bpe import byte_alphabet
from faktum.llm import textkit
from faktum.llm.storage import table

#: White space of the tokenizer's `\\s`: Unicode's White_Space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_WHITE = re.compile(f"[{WHITE}]+")
#: Python's str.split() also cuts at these; the tokenizer doesn't.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Chunks kept by a process; when it is full the cache starts afresh.
CACHE = 300_000
RUN_CHARS = 16 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PairIndexBpe:
    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> PairIndexBpe:
        return PairIndexBpe(path)

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.token = {i: t for t, i in (self.vocab | self.special).items()}
        self.suffix = model["end_of_word_suffix"] or ""
        self.size = max(self.token) + 1
        left, right, into = [], [], []
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left.append(self.vocab[a])
            right.append(self.vocab[b])
            into.append(self.vocab[a + b])
        self.left, self.right, self.into = (np.array(x, np.int64) for x in (left, right, into))
        code = self.left * self.size + self.right
        self.order = np.argsort(code)
        self.codes = code[self.order]
        chars = byte_alphabet()
        self.inner, self.last = np.zeros(256, np.int64), np.zeros(256, np.int64)
        for c, b in chars.items():
            self.inner[b], self.last[b] = self.vocab[c], self.vocab[c + self.suffix]
        self.cache: dict[str, tuple[int, str, str]] = {}

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, or -1."""
        code = a * self.size + b
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == code, self.order[at], -1)

    def encode_words(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each (distinct, non-empty) word."""
        if not words:
            return []
        buf = np.frombuffer(b"".join(words), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])])
        symbol = self.inner[buf]
        symbol[bounds[1:] - 1] = self.last[buf[bounds[1:] - 1]]
        n = len(symbol)
        follow, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        follow[bounds[1:] - 1] = -1
        before[bounds[:-1]] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Adds the pairs that start at these positions to the index."""
            rank = self._rank(symbol[at], symbol[follow[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]]))
            for own, r in zip(np.split(at, cut[1:]), rank[cut].tolist(), strict=True):
                if r in index:
                    index[r].append(own)
                else:
                    index[r] = [own]
                    heapq.heappush(active, r)

        enter(np.flatnonzero(follow >= 0))
        while active:
            r = heapq.heappop(active)
            a, b, c = self.left[r], self.right[r], self.into[r]
            at = index.pop(r)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            at = at[symbol[at] == a]
            nxt = follow[at]
            fits = nxt >= 0
            at, nxt = at[fits], nxt[fits]
            fits = symbol[nxt] == b
            at, nxt = at[fits], nxt[fits]
            if a == b and len(at) > 1:  # of a run of the same symbol, every other pair
                linked = np.concatenate([[False], nxt[:-1] == at[1:]])
                head = np.maximum.accumulate(np.where(linked, 0, np.arange(len(at))))
                odd = (np.arange(len(at)) - head) % 2 == 0
                at, nxt = at[odd], nxt[odd]
            if not len(at):
                continue
            after = follow[nxt]
            symbol[at], symbol[nxt] = c, -1
            follow[at] = after
            has = after >= 0
            before[after[has]] = at[has]
            left = before[at]
            enter(np.concatenate([left[left >= 0], at[has]]))
        alive = symbol >= 0
        ids = symbol[alive]
        ends = np.concatenate([[0], np.cumsum(alive)])[bounds]
        return [ids[ends[k] : ends[k + 1]] for k in range(len(words))]

    def pieces(self, chunk: str) -> list[bytes]:
        """The pre-tokenizer's words of a stretch without white space."""
        own = unicodedata.normalize("NFC", chunk)
        own = "".join(map(str.lower, own)) if "Σ" in own else own.lower()
        return [x.encode() for x in _PIECES.findall(own)]

    def _learn(self, chunks: set[str]) -> None:
        if len(self.cache) + len(chunks) > CACHE:
            self.cache = {}
        split = {c: self.pieces(c) for c in chunks}
        words = list({w for own in split.values() for w in own})
        ids = dict(zip(words, self.encode_words(words), strict=True))
        for c, own in split.items():
            all_ = [i for w in own for i in ids[w].tolist()]
            self.cache[c] = (len(all_), " ".join(map(str, all_)), " ".join([self.token[i] for i in all_]))

    def _chunks(self, text: str) -> list[str]:
        return [x for x in _WHITE.split(text) if x] if _SEPARATORS.search(text) else text.split()

    def encode_texts(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids in decimal, decoded text) of each text; ids and tokens are joined by one space."""
        parts = [self._stretches(t) for t in texts]
        fresh = {c for own in parts for c, mark in own if not mark and c not in self.cache}
        if fresh:
            if len(self.cache) + len(fresh) > CACHE:
                fresh = {c for own in parts for c, mark in own if not mark}
            self._learn(fresh)
        out = []
        for own in parts:
            found = [(1, str(self.special[c]), c) if mark else self.cache[c] for c, mark in own]
            found = [x for x in found if x[0]]
            out.append((sum(x[0] for x in found), " ".join([x[1] for x in found]), " ".join([x[2] for x in found])))
        return out

    def _stretches(self, text: str) -> list[tuple[str, bool]]:
        if self.marks and self.marks.search(text):
            return [(c, mark) for x in self.marks.split(text) for mark in [x in self.special] for c in ([x] if mark else self._chunks(x))]
        return [(c, False) for c in self._chunks(text)]

    def decode(self, ids: list[int]) -> str:
        """What the file says without a decoder: the tokens joined by one space."""
        return " ".join(self.token[i] for i in ids)


CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches):
        bpe = PairIndexBpe.of(path)
        digest = lambda s: sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (size < RUN_CHARS or hi == lo):
                    size += len(texts[hi] or "")
                    hi += 1
                coded = bpe.encode_texts([t or "" for t in texts[lo:hi]])
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array([x[0] for x in coded], pa.int64()), pa.array([digest(x[1]) for x in coded]), pa.array([digest(x[2]) for x in coded])], schema=CODED)
                lo = hi
        bpe.cache = {}

    return run


def coded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text of docs (doc_id, text).

    Null texts are empty: no ids and an empty decoded text.  Null doc_ids and rows that repeat come out as they are; an
    empty table gives an empty result; other columns are never read.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(textkit.tidy(_digests(path or default_path())), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "documents"))
