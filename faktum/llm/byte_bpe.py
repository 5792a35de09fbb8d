"""Byte-level BPE ids from a public tokenizer file, with a cache of chunks.

A text is cut where a space stands before a character other than white space:
the pre-tokenizer always starts a new piece there, so the chunks' ids joined
are the text's ids.  Most chunks are words seen before in this process.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import tiktoken

#: Chunks kept by a process; when it is full the cache starts afresh.
CACHE = 200_000
_INNER = re.compile(r"(?= \S)")
_AMBIGUOUS = re.compile(r" (?:\s|\Z)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: its own where it is printable Latin-1, else the next from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteBpe:
    @staticmethod
    @lru_cache(maxsize=2)
    def of(path: str) -> ByteBpe:
        return ByteBpe(path)

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        own = byte_alphabet()
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        ranks = {bytes(own[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        self.bpe = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.heads: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}

    def clear(self) -> None:
        self.heads, self.tails = {}, {}

    def _fresh(self, chunk: str) -> bytes:
        ids = self.bpe.encode_ordinary(chunk)
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode_bytes(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if self.marks and self.marks.search(text):
            return b"".join(struct.pack("<I", self.special[x]) if x in self.special else self.encode_bytes(x) for x in self.marks.split(text) if x)
        if len(self.heads) + len(self.tails) > CACHE:
            self.clear()
        if _AMBIGUOUS.search(text):
            chunks = _INNER.split(text)
            head, tails = chunks[0], [c[1:] for c in chunks[1:]]
        else:
            head, *tails = text.split(" ")
        out = [self.heads.get(head), *map(self.tails.get, tails)]
        if None in out:
            for k, x in enumerate(out):
                if x is None:
                    if k:
                        out[k] = self.tails[tails[k - 1]] = self._fresh(" " + tails[k - 1])
                    else:
                        out[k] = self.heads[head] = self._fresh(head)
        return b"".join(out)
