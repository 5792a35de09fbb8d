"""Languages of scripts by weighted patterns: overlapping hits of all patterns in one pass over Arrow batches."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faktum.functions.automaton import Automaton, joined

#: What speaks for a language, by weight; of equal scores the language that stands first is the better one.
PATTERNS = {
    "shell": {5: ["export ", "set -e", "if [", "case $", "; then\n", "; do\n", "cd $", "curl -O http", "xattr -c "], 10: [" && curl ", " && chmod +x ", "post_install() {", "pre_install() {", "post_upgrade() {", "pre_upgrade() {", "post_remove() {", "pre_remove() {"]},
    "python": {10: ["if __name__", "import os", "base64.b64decode"], 5: ["def ", "except ", "exec(", "subprocess.", "self."]},
    "powershell": {10: ["$ErrorActionPreference", "[System.Convert]", " -bxor "], 5: ["Write-Host", "Invoke-", "New-Object"]},
    "perl": {10: ["use strict;", "use warnings;", "use strict\n", "use warnings\n"], 5: ["my $", "chomp"]},
    "php": {10: ["<?php", "$_SERVER", "$_POST", "$_GET", "add_filter(", "add_action("], 5: ["esc_html(", "preg_replace("]},
    "batch": {10: ["@echo", "@ECHO", "%~dp0"], 5: ["SETLOCAL", "GOTO ", "IF EXIST"]},
    "vbs": {10: ["WScript.", "Option Explicit"], 5: ["CreateObject(", "End Sub", "End Function"]},
    "lua": {10: ["setmetatable", "getmetatable", "getfenv", "setfenv"], 5: ["ipairs(", "pairs(", "elseif "]},
    "javascript": {10: ["module.exports"], 5: ["(function(", "===", "console.log(", "document.", "window.", "addEventListener", "var ", "let ", "const "]},
    "c": {10: ["#include <", '#include "', "section .text", "[BITS 32]"]},
    "kotlin": {5: ["package ", "fun main(", "val "], 10: ["import kotlin", "suspend fun "]},
    "dockerfile": {10: ["\nFROM ", "FROM scratch", "\nCMD [", "\nENTRYPOINT", "\nHEALTHCHECK"], 5: ["\nRUN ", "\nWORKDIR ", "\nCOPY ", "\nEXPOSE ", "\nVOLUME "]},
    "clojure": {10: ["(defn ", "(defn- ", "(defmacro ", "(defprotocol ", "(defmethod ", "(defmulti ", "(defrecord ", "(deftype ", "(ns ", ":require ", ":require\n", "#?(:clj", "#?(:cljs"], 5: ["(let [", "(if-let [", "(when-let [", "(fn [", "#'"]},
    "applescript": {10: ["do shell script", 'tell application "', "quoted form of", "POSIX path of", "with hidden answer"], 5: ["end tell", "end repeat", "on run"]},
}
#: Bytes at the beginning that are looked at, those at the end where the beginning holds little, and how
#: many bytes but white space are enough; the least score; how near, in hundredths of the best, the next may come.
HEAD, TAIL, LITTLE, LEAST_SCORE, NEAR = 4096, 2048, 16, 10, 60
#: Bytes that are searched at once.
STEP = 1 << 20
#: A language's score ends here.
MOST_SCORE = 65_535
LANGUAGES = tuple(PATTERNS)
_ENTRIES = [(x.encode(), LANGUAGES.index(language), weight) for language, own in PATTERNS.items() for weight, xs in own.items() for x in xs]
_RULES, _MEMBERS = b"===", (b"document.", b"window.")


@lru_cache(maxsize=1)
def _automaton() -> Automaton:
    return Automaton([x for x, _, _ in _ENTRIES])


def score_rows(rows: list[bytes]) -> np.ndarray:
    """(row, language): what the hits add up to, for stretches of up to STEP bytes (one row at least), so that what a batch takes doesn't grow with it."""
    out = np.zeros((len(rows), len(LANGUAGES)), np.int64)
    lo = 0
    while lo < len(rows):
        hi, size = lo + 1, len(rows[lo])
        while hi < len(rows) and size + len(rows[hi]) <= STEP:
            size, hi = size + len(rows[hi]), hi + 1
        out[lo:hi] = _scored(rows[lo:hi])
        lo = hi
    return out


def _scored(rows: list[bytes]) -> np.ndarray:
    """A triple equals sign counts outside longer runs only, and a member access with a member only."""
    out = np.zeros((len(rows), len(LANGUAGES)), np.int64)
    raw, offsets = joined(rows)
    row, end, number = _automaton().hits_in(raw, offsets)
    if not len(row):
        return out
    after = raw[offsets[row] + end]
    before = raw[np.maximum(offsets[row] + end - len(_RULES) - 1, 0)]
    patterns = [x for x, _, _ in _ENTRIES]
    in_run = (number == patterns.index(_RULES)) & ((after == ord("=")) | ((end > len(_RULES)) & (before == ord("="))))
    member = np.isin(number, [patterns.index(x) for x in _MEMBERS]) & ~((after >= ord("a")) & (after <= ord("z")))
    keep = ~(in_run | member)
    languages, weights = (np.array([x[k] for x in _ENTRIES]) for k in (1, 2))
    np.add.at(out, (row[keep], languages[number[keep]]), weights[number[keep]])
    return np.minimum(out, MOST_SCORE)


_SPACE = b" \t\n\x0c\r"
_ITEM = re.compile(rb"(?:---|\.\.\.|-)\Z|--- |- |[A-Za-z0-9_\-./\"']+:(?: |\Z)")


def _lines(head: bytes) -> list[bytes]:
    out = head.split(b"\n")
    return [x for x in (line.strip(_SPACE) for line in out) if x and not x.startswith(b"#")]


def is_data(head: bytes) -> bool:
    """Whether the first bytes are JSON with a key, or mostly keys and items of YAML, rather than a script."""
    if head.startswith(b"#!"):
        return False
    body = head.lstrip(_SPACE)
    if body[:1] in (b"{", b"[") and b'":' in body:
        return True
    whole = head.rpartition(b"\n")[0] if len(head) == HEAD else head
    lines = _lines(whole)
    return len(lines) >= 5 and 10 * sum(_ITEM.match(x) is not None for x in lines) >= 7 * len(lines)


def _tagged(part: bytes) -> bool:
    """Whether a PHP tag opens, or closes where no XML declaration opens."""
    opened = re.findall(rb"(?s)<\?(.{0,3})", part)
    declared = [x for x in opened if x.lower() == b"xml"]
    return len(opened) > len(declared) or (not declared and b"?>" in part)


def decide(head: bytes, tail: bytes | None, scores: np.ndarray) -> str | None:
    """The language of scores that are clear enough, if the bytes have what this language needs besides."""
    ranked = np.argsort(-scores, kind="stable")
    best, second = int(scores[ranked[0]]), int(scores[ranked[1]])
    if best < LEAST_SCORE or (second and second * 100 // best > NEAR):
        return None
    language = LANGUAGES[ranked[0]]
    parts = [head] if tail is None else [head, tail]
    if language == "javascript" and not any(re.search(rb"[;{}]", x) for x in parts):
        return None
    if language == "dockerfile":
        lines = _lines(head)
        if not lines or lines[0].split(None, 1)[0].upper() not in (b"FROM", b"ARG"):
            return None
    if language == "php" and not any(map(_tagged, parts)):
        return None
    return language


def _looked_at(head: bytes, tail: bytes | None, size: int) -> tuple[bytes, bytes | None]:
    little = sum(x not in _SPACE for x in head) < LITTLE if size > HEAD else False
    return head, tail if little else None


def decide_rows(heads: list[bytes | None], tails: list[bytes | None], sizes: list[int | None]) -> tuple[list[str | None], np.ndarray]:
    """Languages, and scores by row and language; a null row has neither."""
    looked = [(b"", None) if h is None else _looked_at(h, t, n) for h, t, n in zip(heads, tails, sizes, strict=True)]
    scores = score_rows([h for h, _ in looked])
    with_tail = [k for k, (_, t) in enumerate(looked) if t is not None]
    if with_tail:
        scores[with_tail] = np.maximum(scores[with_tail], score_rows([looked[k][1] for k in with_tail]))
    kinds = [None if h is None or n < 4 or is_data(h) else decide(*looked[k], scores[k]) for k, (h, n) in enumerate(zip(heads, sizes, strict=True))]
    return kinds, scores


def _ends(content: Column) -> tuple[Column, Column, Column]:
    """Only what is looked at goes to Python; the end only of contents longer than the beginning."""
    return F.substring(content, 1, HEAD), F.when(F.octet_length(content) > HEAD, F.substring(content, -TAIL, TAIL)), F.octet_length(content)


#: Rows that are taken from Arrow at once.
TOGETHER = 256


@F.arrow_udf(T.StringType())
def _language(head: pa.Array, tail: pa.Array, size: pa.Array) -> pa.Array:
    out: list[str | None] = []
    for k in range(0, len(head), TOGETHER):
        heads, tails, sizes = (x.slice(k, TOGETHER).to_pylist() for x in (head, tail, size))
        out += decide_rows(heads, tails, [n or 0 for n in sizes])[0]
    return pa.array(out, pa.string())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _scores(content: pa.Array) -> pa.Array:
    out: list[list[int] | None] = []
    for k in range(0, len(content), TOGETHER):
        rows = content.slice(k, TOGETHER).to_pylist()
        out += [None if x is None else y for x, y in zip(rows, score_rows([x or b"" for x in rows]).tolist(), strict=True)]
    return pa.array(out, pa.list_(pa.int64()))


def language(content: Column) -> Column:
    """The language of a script without other signs, or null."""
    return _language(*_ends(content))


def scores(content: Column) -> Column:
    """(language, score) of the languages with hits anywhere in a binary content, in the order of LANGUAGES; null for null."""
    pairs = F.transform(_scores(content), lambda x, i: F.struct(F.element_at(F.array(*map(F.lit, LANGUAGES)), i + 1).alias("language"), x.alias("score")))
    return F.filter(pairs, lambda x: x["score"] > 0)
