import collections
import re

import duckdb
import numpy as np
import pytest

from faktum.llm import phrases, textkit
from faktum.llm.phrases import OP12_SQL, collocations, op12_phrases

SF = "/root/testdata/sf0.001"
COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute_force(rows, longest, least, inside, limit):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n, out = collections.Counter(), collections.Counter(), []
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    count[lang, tuple(w[i : i + k])] += 1
    candidates = {x: a for x, a in count.items() if len(x[1]) > 1 and a >= least}
    for lang in n:
        kept = []
        for (own, p), a in candidates.items():
            if own != lang:
                continue
            longer = [b for (o, q), b in candidates.items() if o == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            score, _, left, right = min((1000000 * a * a // (count[lang, p[:k]] * count[lang, p[k:]]), k, count[lang, p[:k]], count[lang, p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(kept)[:limit])]
    return out


def test_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    assert sorted(map(tuple, op12_phrases(spark, SF).select(*COLUMNS).collect())) == sorted(con.sql(OP12_SQL).fetchall())


@pytest.mark.parametrize(("task", "longest", "ranked"), [(1 << 20, 3, 1 << 16), (64, 3, 8), (16, 4, 4)])
def test_equals_brute_force(spark, monkeypatch, task, longest, ranked):
    """With common prefixes dealt out over tasks, short runs, ranks in levels, and odd rows."""
    monkeypatch.setattr(phrases, "ROWS_A_TASK", task)
    monkeypatch.setattr(phrases, "HOT", 64)
    monkeypatch.setattr(phrases, "RUN_BYTES", 300)
    monkeypatch.setattr(phrases, "RANKED", ranked)
    rng = np.random.default_rng(4)
    vocabulary = ["a", "B", "É", "of", "the", "x-y", "ß1", " ", "new", "york"]
    rows = [("".join(rng.choice(vocabulary) + rng.choice([" ", "\t", "  ", ". ", "\n", ","], p=[0.7, 0.1, 0.05, 0.05, 0.05, 0.05]) for _ in range(rng.integers(1, 60))), [None, "en", "und", "de"][i % 4]) for i in range(150)]
    rows += [("of the New York " * 400, "en"), ("a" * 5000, "en"), (None, "en"), ("", None), (".,;", "xx"), ("of the", "en"), ("of the", "en"), ("Ω Ω " * 30, "el")]
    df = spark.createDataFrame(rows, "text string, lang string").withColumn("ids", phrases.F.lit(1)).withColumn("n", phrases.F.lit("n")).repartition(3)
    got = collocations(df, longest, 3, 50, 12).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows, longest, 3, 50, 12))


def test_colliding_ids_start_again(spark, monkeypatch):
    real = phrases._ids
    monkeypatch.setattr(phrases, "_ids", lambda h, at, langs, seed: real(h & textkit.U64(3) if seed < 2 else h, at, langs, seed))
    rows = [("one two three four five six seven " * 12, "en")]
    got = collocations(spark.createDataFrame(rows, "text string, lang string"), 3, 3, 50, 5).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute_force(rows, 3, 3, 50, 5))


def test_empty_table(spark):
    df = spark.createDataFrame([("a", "en")], "text string, lang string")
    assert collocations(df.limit(0)).collect() == []
    assert collocations(df).collect() == []


def test_large_counts_are_exact(spark):
    """Products beyond 64 bits."""
    known = [([1], 3_000_000_019), ([2], 2_999_999_957), ([1, 2], 2_999_999_929)]
    df = spark.createDataFrame(known, "ids array<long>, a long")
    words = spark.createDataFrame([(1, "en", "x", known[0][1]), (2, "en", "y", known[1][1])], "id long, lang string, word string, n long")
    got = phrases._scored(df.filter("size(ids) > 1"), words).first()
    a = known[2][1]
    assert (got.a, got.l, got.r, got.score) == (a, known[0][1], known[1][1], 1000000 * a * a // (known[0][1] * known[1][1]))
