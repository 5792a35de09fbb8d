import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faktum.llm.packing import Limits, op10_packing, pack, plan

SF = "/root/testdata/sf0.001"


def hold(rows, texts, capacity=2048):
    """Each document's pieces are its ids in order; sequences are gapless and within capacity."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    assert set(by_doc) == set(texts)
    for doc_id, pieces in by_doc.items():
        ids = [*library.encode(texts[doc_id] or "", add_special_tokens=False).ids, 0]
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        at = 0
        for r in pieces:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in pieces[1:])
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return by_sequence


def test_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op10_packing(spark, SF).collect()
    used = len(hold(rows, texts))
    assert used <= -(-sum(r.length for r in rows) // 2048) + 1


def test_odd_rows(spark):
    texts = {1: None, 2: "", 3: "word " * 5000, 4: "x", 5: "x"}
    rows = pack(spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "text", "0 AS length", "1 AS part")).collect()
    hold(rows, texts)
    twice = pack(spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")).collect()
    assert len(twice) == 4 and sorted(r.offset for r in twice if r.sequence_id == twice[0].sequence_id)[0] == 0
    assert len({(r.sequence_id, r.offset) for r in twice}) == 4
    assert pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("limits", [{}, {"documents": 3}, {"attention": 300_000}, {"documents": 4, "attention": 400_000}])
def test_plan_keeps_every_limit(rule, limits):
    rng = random.Random(7)
    lengths = Counter(min(500, max(1, int(rng.lognormvariate(4, 1)))) for _ in range(3000))
    own = Limits(tokens=1000, rule=rule, **limits)
    made = plan(lengths, own)
    placed = Counter()
    for kind, count in made.kinds:
        assert sum(kind) <= 1000 and len(kind) <= (own.documents or 1000) and sum(x * x for x in kind) <= (own.attention or 10**6)
        for x in kind:
            placed[x] += count
    assert placed == lengths
    bound = max(-(-sum(k * n for k, n in lengths.items()) // 1000), -(-3000 // (own.documents or 3000)), -(-sum(k * k * n for k, n in lengths.items()) // (own.attention or 10**9)))
    assert sum(c for _, c in made.kinds) <= 1.15 * bound + 1


def test_too_long_for_a_sequence():
    with pytest.raises(ValueError):
        plan({11: 1}, Limits(tokens=10))
