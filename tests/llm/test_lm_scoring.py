import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from faktum.llm import context_tree as tree
from faktum.llm import lm_scoring, textkit
from faktum.llm.lm_scoring import op6_lm_scoring, score_documents

SF = "/root/testdata/sf0.001"


def brute_force(texts, held, depth):
    """Context-tree weighting by its definition, one symbol after the other."""
    counts = collections.Counter()

    def symbols(text):
        own = bytes([tree.START]) * depth + text.encode().lower() + bytes([tree.END])
        for i in range(depth, len(own)):
            yield own[i - depth : i][::-1], own[i]

    def decisions(symbol):
        p = 1
        for j in range(8):
            bit = symbol >> (7 - j) & 1
            yield p, bit
            p = p * 2 + bit

    children = collections.defaultdict(set)
    for text, out in zip(texts, held):
        if out:
            continue
        for context, symbol in symbols(text):
            for p, bit in decisions(symbol):
                for d in range(depth + 1):
                    counts[context[:d], p, bit] += 1
                    if d:
                        children[context[: d - 1], p].add(context[:d])

    def ab(s, p):
        return counts[s, p, 0], counts[s, p, 1]

    def log_pe(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    known = {}

    def log_pw(s, p):
        if (s, p) not in known:
            pe = log_pe(*ab(s, p))
            known[s, p] = pe if len(s) == depth else math.log(0.5) + np.logaddexp(pe, sum(log_pw(c, p) for c in children[s, p]))
        return known[s, p]

    def one(context, p, d=0):
        s = context[:d]
        a, b = ab(s, p)
        kt = (b + 0.5) / (a + b + 1)
        if d == depth or not sum(ab(context[: d + 1], p)):
            return kt if a + b else 0.5
        stop = math.exp(math.log(0.5) + log_pe(a, b) - log_pw(s, p))
        return stop * kt + (1 - stop) * one(context, p, d + 1)

    return [sum(math.log10(one(c, p) if bit else 1 - one(c, p)) for c, x in symbols(t) for p, bit in decisions(x)) for t in texts]


@pytest.mark.parametrize("depth", [2, 3, 5])
def test_equals_the_definition(spark, depth):
    texts = ["abracadabra", "Abra", "", "the cat sat on the mat\nthe cat", "éü the cat", "zz", "the mat", "cadabra cat"] * 2
    rows = list(enumerate(texts))
    held = [zlib.crc32(str(i).encode()) % 3 == 0 for i, _ in rows]
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), depth, 3, 64).collect()}
    for i, want in enumerate(brute_force(texts, held, depth)):
        assert got[i].held_out == held[i]
        assert got[i].score == pytest.approx(want, rel=1e-5), texts[i]


def test_regions_and_few_buckets(spark, monkeypatch):
    """Counts that are added up region by region, as a tree, score alike."""
    monkeypatch.setattr(lm_scoring, "REGION", 2)
    monkeypatch.setattr(lm_scoring, "FAN", 2)
    monkeypatch.setattr(lm_scoring, "BUCKETS", 3)
    test_equals_the_definition(spark, 3)


def test_base_and_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in op6_lm_scoring(spark, SF).collect()}
    held = {x.doc_id: zlib.crc32(str(x.doc_id).encode()) % 10 == 0 for x in docs}
    words = {x.doc_id: (x.text or "").encode().lower().split() + [None] for x in docs}
    c = collections.Counter(w for i, own in words.items() if not held[i] for w in own)
    total, kinds = sum(c.values()), len(c)
    for i, own in words.items():
        want = sum(math.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        assert (got[i].held_out, got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (held[i], len(own), sum(w in c for w in own), total)
        assert got[i].base_score == pytest.approx(want, rel=1e-9)


def test_odd_rows(spark):
    rows = [(None, "a b", 1), (1, None, 2), (1, None, 2), (2, "", 3), (3, "x " * 300_000, 4), (4, " \n", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int").withColumnRenamed("block", "block")
    got = score_documents(df, block_bytes=1000).collect()
    assert sorted(x.n_tokens for x in got) == [1, 1, 1, 1, 3, 300_001]
    assert all(x.score < 0 and math.isfinite(x.score) for x in got)
    assert score_documents(df.limit(0)).collect() == []


def test_words_and_grams():
    texts = ["A  bc d\tE", None, "", "x"]
    buf, offsets = textkit.utf8(pa.array(texts))
    h, at, first = textkit.words(buf, offsets)
    assert list(np.diff(first)) == [3, 0, 0, 1]
    g, places = tree.grams(buf, offsets, 2)
    assert list(np.diff(places)) == [len((t or "").encode()) + 1 for t in texts]
    assert g[-1] == (ord("x") << 16) | (tree.START << 8) | tree.END
