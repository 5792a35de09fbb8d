import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from faktum.functions import bytes as B
from faktum.functions import languages
from faktum.functions import text as T
from faktum.operators import located


def test_windows():
    rng = random.Random(1)
    noise = bytes(rng.randrange(256) for _ in range(3000))
    data = bytes(2048) + noise + bytes(1000)
    overall, peak, size, offset, spans = B.windowed(data)
    assert 0 < overall < peak <= 8 and offset == 2048 and sum(n for _, n in spans) == size
    assert B.windowed(b"") == (0.0, 0.0, 0, 0, []) and B.windowed(bytes(10)) == (0.0, 0.0, 10, 0, [(0, 10)])
    # equal runs: the first is the offset, and order is kept
    twin = noise[:1024] + bytes(1024) + noise[:1024]
    assert B.windowed(twin)[3] == 0 and B.windowed(twin)[4] == [(0, 1024), (2048, 1024)]


def test_entropy():
    assert B.shannon(B.histogram(b"")) == 0 and math.isclose(B.shannon(B.histogram(b"ab")), 1)


def test_empty_text_gives_nothing(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("",), (None,), ("a",)], "t string")
    own = T.text_metrics(F.col("t"))
    assert len(own) == 34
    got = df.select(*(v.alias(k) for k, v in own.items())).collect()
    assert all(v is None for r in got[:2] for v in r) and got[2].total_lines == 1


def test_registered_functions(spark):
    from faktum.functions.register import register
    from faktum.queries_sources import sample_tar

    assert "archive_members" in register(spark)
    row = spark.sql("SELECT is_hex_string('deadbeef') a, is_hex_string('xyz') b, is_likely_base64('QWxhZGRpbjpvcGVuIHNlc2FtZQ==') c, file_stem('/a/.b.tar.gz') d, file_stem('.x') e").first()
    assert tuple(row) == (True, False, True, ".b.tar", ".x")
    got = spark.createDataFrame([(sample_tar(),)], "content binary").createOrReplaceTempView("files") or spark.sql("SELECT m.path FROM files, LATERAL archive_members(content, 'tar') m").collect()
    assert [r.path for r in got] == ["t/a", "t/b", "t/link"]


def test_histograms_of_any_stretches(monkeypatch):
    """Pieces are counted some at a time, so that a batch of any size takes the memory of one stretch; the counts are the same."""
    rng = np.random.default_rng(4)
    values = [None, b"", *(rng.integers(0, 256, int(n)).astype(np.uint8).tobytes() for n in rng.integers(0, 3000, 40)), b"ab" * 9000, b"abcd\0efgh", b"x"]
    column = pa.array(values, pa.binary())
    monkeypatch.setattr(B, "STEP", 4096)
    found = [(k, h) for k, h in B.histograms(*B.flat(column))]
    assert len(found) > 10 and max(len(h) for _, h in found) <= B.TOGETHER
    assert np.array_equal(np.concatenate([h for _, h in found]), [B.histogram(x or b"") for x in values])
    for x, own in zip(values, B._windows(column).to_pylist(), strict=True):
        overall, peak, size, offset, spans = B.windowed(x or b"")
        assert np.allclose([own["overall"], own["peak"]], [overall, peak]) and (own["peak_bytes"], own["peak_offset"]) == (size, offset)
        assert [(s["offset"], s["len"]) for s in own["spans"]] == spans
    assert B._byte_counts(column).to_pylist()[-2:] == [[{"byte_hex": f"{b:02X}", "n": 1} for b in sorted(b"abcd\0efgh")], [{"byte_hex": "78", "n": 1}]]
    assert [len(x) for x in located._strings(column).to_pylist()[-3:]] == [1, 2, 0]
    rows = [x or b"" for x in values]
    whole = languages.score_rows(rows)
    monkeypatch.setattr(languages, "STEP", 100)
    assert np.array_equal(languages.score_rows(rows), whole)


def test_places_of_many_invisible_characters(spark):
    """Each text is cut once, whatever the number of runs; the plan holds one split by them."""
    text = "\ufeffa" + "\u200b".join("é" * (k % 5) + "x" for k in range(200))
    spans = T.invisible_spans(F.col("t"))
    df = spark.createDataFrame([(text,), ("plain",), ("",), (None,), ("\u200b",)], "t string").select(spans.alias("s"))
    got = [r.s if r.s is None else [tuple(x) for x in r.s] for r in df.collect()]
    want, at = [], 0
    for ch in text:
        if ch == "\u200b":
            want.append((at, 3))
        at += len(ch.encode())
    assert got[0] == want[:64] and got[1] == got[2] == [] and got[4] == [(0, 3)]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_all_places_of_invisible_characters(spark, monkeypatch):
    """All runs, however many, across stretches and nulls; the first are those that `invisible_spans` gives."""
    from faktum.queries import ORACLES

    rand = random.Random(3)
    some = ["\ufeff", "\u200b", "\u200e", "\u2060", "\u2061", "\ufe0f", "\ufe10", "\U000e0001", "\U000e0000", "\U000e007f", "\U000e0080", "\U000e0100", "\U000e01ef", "\U000e01f0", "\U000f0001", "a", "\u00e9", "\u20ac", "\U0001f600", "\n"]
    texts = [None, "", "\ufeff", "\ufeff\ufeff", "x" + "a\u200b" * 5000] + ["".join(rand.choice(some) for _ in range(rand.randint(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(2)
    got = df.select("k", T.all_invisible_spans(F.col("t")).alias("all"), T.invisible_spans(F.col("t")).alias("first")).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r["all"] is None) == (texts[r.k] is None) and (r["all"] or [])[:64] == (r["first"] or [])
    assert [tuple(x) for x in next(r["all"] for r in got if r.k == 4)] == [(2 + 4 * k, 3) for k in range(5000)]
    column = pa.array([x and x.encode() for x in texts], pa.binary())
    whole = T.in_stretches(column, T._invisible)
    monkeypatch.setattr(B, "STEP", 50)
    assert T.in_stretches(column, T._invisible).equals(whole)
    assert "64" not in ORACLES["txt_located"]


def test_located_texts_without_a_filled_line(spark, tmp_path):
    from faktum.queries import QUERIES

    spark.createDataFrame([(1, "\n\n"), (2, "a. b, c"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_spans, r.first_offset, r.last_offset, r.covered, r.line_offset, r.line_bytes) for r in QUERIES["txt_located"](spark, str(tmp_path)).collect()}
    assert got == {1: (0, None, None, None, 0, 0), 2: (2, 5, 14, 9, 0, 19)}


def test_metrics_of_empty_texts_and_long_runs(spark):
    """A text without lines divides nothing; a run of any length is one match."""
    from faktum.plans.facts import metrics
    from faktum.sources.files import from_documents

    hidden = "\u200b\u2060\U000e0101"
    docs = spark.createDataFrame([(1, ""), (2, None), (3, "x" + hidden * 30_000 + "y")], "doc_id long, text string")
    got = {}
    for r in metrics(from_documents(docs)).select("file_id", "key", "value", "spans").collect():
        got.setdefault(r.file_id, {})[r.key] = (r.value, [tuple(x) for x in r.spans])
    assert sorted(len(x) for x in got.values())[:2] == [4, 5]
    whole = next(x for x in got.values() if len(x) > 5)
    assert whole["text.invisible_chars"] == (90_000.0, [(1, 300_000)])
    lines = docs.select("doc_id", *(v.alias(k) for k, v in T.line_metrics(F.col("text")).items())).orderBy("doc_id").collect()
    assert lines[0].total_lines == 0.0 and all(v is None for v in lines[0][2:]) and lines[2].total_lines == 1.0


def test_definitions_are_those_among_all_symbols(spark):
    from faktum.sources import python_source as P

    text = open(P.__file__).read() + "\nf = lambda a: lambda *b: 0\nimport x.y as z, w\nasync def g(): from .q import r\n"
    every = P.symbols_of(text)
    for kinds in ({"import"}, {"function"}, {"import", "function"}):
        assert P.definitions(text, frozenset(kinds)) == [x for x in every if x["kind"] in kinds]
    sources = spark.createDataFrame([(str(k), text if k % 2 else "a b") for k in range(3)], "file_id string, text string")
    got = P.symbols(sources, ("import",)).collect()
    assert {r.kind for r in got} == {"import"} and len(got) == sum(x["kind"] == "import" for x in every) and P.symbols(sources, ("error",)).count() == 2
