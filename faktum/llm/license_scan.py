"""Licence notices by a positional index of rare words.

Templates are short phrases and whole notices.  The index maps each word of the
templates to its postings, the (template, position) pairs; it is small and
fixed by the templates.  How many texts have each of its words, hence the IDF,
is counted over all texts first.

1. Look up: of a text's licence words, each template takes the RARE ones of the
   highest IDF among its own.  A text that lacks too many of them (any word of a
   phrase, half of the words of a notice) is no candidate.
2. Intersect: for a phrase, the occurrences of its rarest word, each minus the
   word's position, are starts, and those stay at which every other word stands
   in its relative position.  For a notice, the starts that its rare words
   propose are gathered within SLACK words, as notices get names and line breaks
   inserted; where half of the rare words agree, the notice's share is the IDF
   of its words that stand within SLACK words of their place, over that of all.
3. Verify: a notice counts if its share is at least SHARE and each of its
   mandatory phrases stands inside the same stretch.

Nothing is cut short: all places of all templates are found in whole texts, and
words are compared by their bytes.  `scan` gives the places themselves.

Null texts are empty; texts without words have no labels and score 0.  Rows that
repeat are scanned each, a null id stays null, other columns are not read,
whatever their names.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm import textkit
from faktum.llm.storage import table

RARE, SLACK, SHARE = 12, 24, 0.6
RUN_BYTES = 2 << 20


@dataclass(frozen=True)
class Template:
    """A phrase, or a notice with the phrases that it can't do without."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()


#: Fixed: the phrases of the base labels.
BASE = (Template("mit", "mit license"), Template("apache", "apache license"), Template("gpl", "general public license"))
#: Fixed: other names of licences, and the public texts of their notices.
NAMES = (
    Template("lgpl", "lesser general public license"),
    Template("lgpl", "library general public license"),
    Template("agpl", "affero general public license"),
    Template("mpl", "mozilla public license"),
    Template("epl", "eclipse public license"),
    Template("bsl", "boost software license"),
    Template("bsd", "bsd license"),
    Template("bsd", "bsd 2 clause"),
    Template("bsd", "bsd 3 clause"),
    Template("isc", "isc license"),
    Template("zlib", "zlib license"),
    Template("cc", "creative commons"),
    Template("cc", "cc by"),
    Template("cc0", "cc0 1 0"),
)
NOTICES = (
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    Template(
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("apache org licenses", "in compliance with the license"),
    ),
    Template(
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu general public license", "free software foundation"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistribution and use in source and binary forms", "must retain the above copyright notice"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee is hereby granted",),
    ),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at", ("mozilla public license",)),
    Template(
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented",
        ("the origin of this software must not be misrepresented",),
    ),
    Template("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", ("any person or organization obtaining a copy",)),
)
TEMPLATES = BASE + NAMES + NOTICES

FOUND_DDL = "array<struct<template: int, label: string, places: array<long>, share: double>>"
_FOUND = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("places", pa.list_(pa.int64())), ("share", pa.float64())]))


def words_of(text: str) -> list[bytes]:
    """Words of a short text, as bytes."""
    raw = np.frombuffer(text.encode(), np.uint8)
    _, _, start, end = textkit.located(raw, np.array([0, len(raw)]), textkit.NO_LETTER)
    return [textkit.fold(raw[a:b]).tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]


class Index:
    """The templates' words by number, and the postings of each."""

    def __init__(self, templates: tuple[Template, ...]):
        self.templates = templates
        self.texts = [words_of(t.text) for t in templates]
        needed = [[words_of(p) for p in t.phrases] for t in templates]
        self.words = sorted({w for x in [*self.texts, *(p for own in needed for p in own)] for w in x})
        number = {w: k for k, w in enumerate(self.words)}
        self.ids = [np.array([number[w] for w in x], np.int64) for x in self.texts]
        self.phrases = [[np.array([number[w] for w in p], np.int64) for p in own] for own in needed]
        raw = np.frombuffer(b" ".join(self.words), np.uint8)
        hashes, _, start, end = textkit.located(raw, np.array([0, len(raw)]), textkit.NO_LETTER)
        self.order = np.argsort(hashes)
        self.hashes, self.raw, self.start, self.size = hashes[self.order], raw, start, end - start
        self.idf = np.ones(len(self.words))

    def number(self, buf: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word of a text, -1 for one that no template has."""
        spot = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        out = np.where(self.hashes[spot] == h, self.order[spot], -1)
        hit = np.flatnonzero(out >= 0)
        own = out[hit]
        good = end[hit] - start[hit] == self.size[own]
        hit, own = hit[good], own[good]
        size = self.size[own]
        same = np.zeros(len(out), bool)
        if len(hit):
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            equal = textkit.fold(buf[np.repeat(start[hit], size) + place]) == self.raw[np.repeat(self.start[own], size) + place]
            same[hit] = np.logical_and.reduceat(equal, np.cumsum(size) - size)
        return np.where(same, out, -1)

    def rarest(self, ids: np.ndarray) -> np.ndarray:
        """The different words, those of the highest IDF first."""
        own = np.unique(ids)
        return own[np.lexsort((own, -self.idf[own]))]


def _numbered(index: Index, batches, column: str = "text"):
    """For each run of texts: first row, numbers and text of its words, first word of each text."""
    for batch in batches:
        buf, offsets = textkit.utf8(batch.column(column))
        for lo, hi in textkit.runs(offsets, RUN_BYTES):
            own = buf[offsets[lo] : offsets[hi]]
            h, at, start, end = textkit.located(own, offsets[lo : hi + 1] - offsets[lo], textkit.NO_LETTER)
            yield batch, lo, hi, index.number(own, h, start, end), at, np.searchsorted(at, np.arange(hi - lo + 1))


def _frequencies(index: Index):
    def run(batches):
        total, rows = np.zeros(len(index.words), np.int64), 0
        for _, lo, hi, number, at, _ in _numbered(index, batches):
            known = number >= 0
            total += np.bincount(np.unique(at[known] * len(index.words) + number[known]) % len(index.words), minlength=len(index.words))
            rows += hi - lo
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(total)), -1)), pa.array(np.append(total, rows))], names=["word", "n"])

    return run


def weigh(index: Index, docs: DataFrame) -> Index:
    """Sets the IDF of the index's words from all texts; the driver meets one count a word of the templates."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(textkit.tidy(_frequencies(index)), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    n = {r["word"]: r["n"] for r in counts.collect()}
    index.idf = np.array([math.log((n.get(-1, 0) + 1) / (n.get(k, 0) + 1)) + 1 for k in range(len(index.words))])
    return index


def _standing(index: Index, ids: np.ndarray, number: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """Word numbers at which the phrase starts, in texts that are allowed."""
    anchor = index.rarest(ids)[0]
    position = int(np.flatnonzero(ids == anchor)[0])
    starts = np.flatnonzero((number == anchor) & allowed[at]) - position
    starts = starts[(starts >= 0) & (starts + len(ids) <= len(number))]
    for k in sorted(range(len(ids)), key=lambda k: -index.idf[ids[k]]):
        starts = starts[(number[starts + k] == ids[k]) & (at[starts + k] == at[np.minimum(starts + position, len(at) - 1)])]
    return starts


def _aligned(index: Index, t: int, number: np.ndarray, chosen: np.ndarray) -> list[tuple[int, float]]:
    """(start, share) of a notice in one text, whose words are `number`, by the rare words `chosen`."""
    ids = index.ids[t]
    found = np.flatnonzero(np.isin(number, chosen))
    by_word = np.argsort(ids, kind="stable")
    lo, hi = np.searchsorted(ids[by_word], number[found]), np.searchsorted(ids[by_word], number[found], "right")
    each = hi - lo
    posting = by_word[np.repeat(lo, each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)]
    start = np.repeat(found, each) - posting
    word = np.repeat(number[found], each)
    order = np.argsort(start, kind="stable")
    start, word = start[order], word[order]
    proposals = []
    for shift in (0, SLACK // 2):  # two grids, so that neighbours meet in one of them
        cell = (start + shift) // SLACK
        pairs = np.unique(np.stack([cell, word], axis=1), axis=0)
        value, votes = np.unique(pairs[:, 0], return_counts=True)
        for c in value[2 * votes >= len(chosen)].tolist():
            own = start[np.searchsorted(cell, c) : np.searchsorted(cell, c, "right")]
            proposals.append(int(own[len(own) // 2]))
    known = np.flatnonzero(number >= 0)
    wide = len(number) + 4 * SLACK + len(ids)
    spots = np.sort(number[known] * wide + known)
    weights, out = index.idf[ids], []
    for begin in sorted(set(proposals)):
        low = ids * wide + np.maximum(np.arange(len(ids)) + begin - SLACK, 0)
        k = np.searchsorted(spots, low)
        near = (k < len(spots)) & (spots[np.minimum(k, len(spots) - 1)] <= ids * wide + np.arange(len(ids)) + begin + SLACK)
        out.append((begin, float(weights[near].sum() / weights.sum())))
    taken: list[tuple[int, float]] = []
    for begin, share in sorted(out, key=lambda x: (-x[1], x[0])):
        if share >= SHARE and all(abs(begin - other) > len(ids) // 2 for other, _ in taken):
            taken.append((begin, share))
    return sorted(taken)


def find(index: Index, number: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[list[dict]]:
    """What each text of a run has: template, label, places (word numbers from 0) and the greatest share."""
    n = len(first) - 1
    out: list[list[dict]] = [[] for _ in range(n)]
    present = np.zeros((n, len(index.words)), bool)
    known = number >= 0
    present[at[known], number[known]] = True
    for t, template in enumerate(index.templates):
        rare = index.rarest(index.ids[t])
        has = present[:, rare]
        if not template.phrases:
            starts = _standing(index, index.ids[t], number, at, has.all(axis=1))
            for text in np.unique(at[starts]).tolist():
                own = starts[np.searchsorted(at[starts], text) : np.searchsorted(at[starts], text, "right")] - first[text]
                out[text].append({"template": t, "label": template.label, "places": own.tolist(), "share": 1.0})
            continue
        chosen = has & (np.cumsum(has, axis=1) <= RARE)
        candidates = (2 * chosen.sum(axis=1) >= min(RARE, len(rare))) & present[:, np.unique(np.concatenate(index.phrases[t]))].all(axis=1)
        if not candidates.any():
            continue
        needed = [_standing(index, p, number, at, candidates) for p in index.phrases[t]]
        for text in np.flatnonzero(candidates).tolist():
            lo, hi = int(first[text]), int(first[text + 1])
            inside = [x[(x >= lo) & (x < hi)] - lo for x in needed]
            if any(not len(x) for x in inside):
                continue
            places = [
                (begin, share)
                for begin, share in _aligned(index, t, number[lo:hi], rare[chosen[text]])
                if all(((x >= begin - 2 * SLACK) & (x < begin + len(index.ids[t]) + 2 * SLACK)).any() for x in inside)
            ]
            if places:
                out[text].append({"template": t, "label": template.label, "places": [max(b, 0) for b, _ in places], "share": max(s for _, s in places)})
    return out


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words and what was found: template (its number), label, places (first words, from 0) and share, for every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    index = weigh(Index(tuple(templates)), rows)

    def run(batches):
        for batch, lo, hi, number, at, first in _numbered(index, batches):
            found = find(index, number, at, first)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(found, _FOUND)], names=["doc_id", "n_words", "found"])

    return rows.mapInArrow(textkit.tidy(run), f"doc_id long, n_words long, found {FOUND_DDL}")


def op11_license_scan(spark, sf_dir: str) -> DataFrame:
    """The score is the greatest share of a template found, times n / (n + 2) for its n words: a name says less than a notice."""
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("found", lambda x: x["template"] < len(BASE))
    starts = F.flatten(F.transform(base, lambda x: x["places"]))
    labels = lambda x: F.array_join(F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))), ",")
    trust = [len(words_of(t.text)) / (len(words_of(t.text)) + 2) for t in TEMPLATES]
    weight = F.array(*(F.lit(x) for x in trust))
    score = F.aggregate("found", F.lit(0.0), lambda top, x: F.greatest(top, x["share"] * weight[x["template"]]))
    return found.select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("found")).alias("labels"), score.alias("score"),
    )
