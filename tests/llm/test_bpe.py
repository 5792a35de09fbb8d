import hashlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from faktum.llm import byte_bpe, pair_index
from faktum.llm.pair_index import PairIndexBpe, coded

ODD = [
    "", "  ", "a  b   c \n d \n\n e ", "ΣΑΣ ΟΔΟΣ", "<|endoftext|>hi <|startoftext|> x<|ENDOFTEXT|>", "it's we'll I'D 'S", "aaaaaaaa hahahahaha lllllll", "x\x1cy \x1f z", "12345 ½² Ⅳ", "e\u0301 \u0301 A\u030a", "日本語 テスト 🙂🙂 👩\u200d👩\u200d👧",
    "İstanbul ǅ ß", "\u00a0a\u3000b\u2003c", "a\u200bb", "tab\t\ttab \t x  ", "--- !!! ... ,,,", "don't<|endoftext|>", "\x00\x01", "__foo_bar __x__", "a\n b\n  c\n \nd", "ﬁ ﬀ \u212a \u212b", "١٢٣ abc123def", "\u0085x \u0085", "word " * 3000,
]


def corpus(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]


def test_word_ids_and_decoding(spark):
    own, library = PairIndexBpe.of(pair_index.default_path()), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = ODD + corpus(spark)
    for text, (n, ids, decoded) in zip(texts, own.encode_texts(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids) == (len(want), " ".join(map(str, want))), text[:80]
        assert decoded == library.decode(want, skip_special_tokens=False) == own.decode(want)


def test_merges_never_make_an_earlier_pair():
    """So ranks applied to all words at once, in ascending order, give what each word alone gives."""
    own = PairIndexBpe.of(pair_index.default_path())
    made = {int(c): r for r, c in enumerate(own.into)}
    assert len(made) == len(own.into)
    assert all(made.get(int(x), -1) < r for r in range(len(own.into)) for x in (own.left[r], own.right[r]))


def test_byte_ids(spark):
    own, library = byte_bpe.ByteBpe.of(byte_bpe.default_path()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ODD + corpus(spark):
        assert own.encode_bytes(text) == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:80]


def test_rows(spark):
    rows = [(1, "a b"), (None, "a b"), (1, "a b"), (2, None), (3, "")]
    got = coded(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n_tokens")).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted([(1, 2), (None, 2), (1, 2), (2, 0), (3, 0)], key=str)
    assert all(r.ids_sha256 == r.decoded_sha256 == empty for r in got if r.n_tokens == 0)
    assert coded(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [1, 3])
def test_full_caches_start_afresh(spark, monkeypatch, size):
    monkeypatch.setattr(pair_index, "CACHE", size)
    monkeypatch.setattr(byte_bpe, "CACHE", size)
    a, b = PairIndexBpe(pair_index.default_path()), byte_bpe.ByteBpe(byte_bpe.default_path())
    for _ in range(2):
        assert a.encode_texts(["one two three", "two"]) == PairIndexBpe.of(pair_index.default_path()).encode_texts(["one two three", "two"])
        assert b.encode_bytes("one two three four") == byte_bpe.ByteBpe.of(byte_bpe.default_path()).encode_bytes("one two three four")
