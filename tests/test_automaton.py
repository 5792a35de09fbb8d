"""The pattern automaton against a look at every place, and the languages that its hits speak for."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from faktum.functions import automaton, languages
from faktum.functions.automaton import Automaton
from faktum.functions.languages import LANGUAGES, decide_rows, score_rows


def by_place(patterns, rows):
    return [(r, i + len(p), k) for r, row in enumerate(rows) for i in range(len(row)) for k, p in enumerate(patterns) if row[i : i + len(p)] == p]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=4).map(lambda x: bytes(97 + b % 2 for b in x)), min_size=1, max_size=8, unique=True), st.lists(st.text(alphabet="ab\0", max_size=40).map(str.encode), max_size=6))
def test_hits_equal_a_look_at_every_place(patterns, rows):
    got = list(zip(*(x.tolist() for x in Automaton(patterns).hits(rows)), strict=True))
    assert sorted(got) == sorted(by_place(patterns, rows))


@pytest.mark.parametrize("lane", [1, 5, 64])
def test_hits_across_lanes_and_rows(monkeypatch, lane):
    monkeypatch.setattr(automaton, "LANE", lane)
    rng = np.random.default_rng(3)
    patterns = [b"abc", b"bc", b"c", b"abcabc", b"aaa", b"\xc3\xa9"]
    rows = [bytes(rng.choice(list(b"abc"), rng.integers(0, 90)).tolist()) for _ in range(20)] + [b"", b"ab", b"c", "né é".encode()]
    assert sorted(zip(*(x.tolist() for x in Automaton(patterns).hits(rows)), strict=True)) == sorted(by_place(patterns, rows))


def test_patterns_must_have_bytes():
    for bad in ([], [b""], [b"a\0"]):
        with pytest.raises(ValueError):
            Automaton(bad)


def score(text, language):
    return int(score_rows([text])[0, LANGUAGES.index(language)])


def test_overlaps_count_each():
    assert score(b"x && curl && curl && curl y", "shell") == 30
    assert score(b"1 -bxor -bxor 2", "powershell") == 20
    assert score(b"(function(function(", "javascript") == 10


def test_marks_that_ask_for_more():
    assert score(b"a === b; c===d; ==== =====", "javascript") == 10
    assert score(b"===", "javascript") == 5 and score(b"=\0===", "javascript") == 5
    assert score(b"document.body window.x this document. the window.A document.", "javascript") == 10
    assert score_rows([b"===", b"=== ", b"document.", b"x"])[:, LANGUAGES.index("javascript")].tolist() == [5, 5, 0, 0]


def kind(text):
    return decide_rows([text[: languages.HEAD]], [text[-languages.TAIL :] if len(text) > languages.HEAD else None], [len(text)])[0][0]


def test_decisions():
    shell = b"export KEY=1\nif [ -d /srv ]; then\n  true\nfi\n"
    assert kind(shell) == "shell"
    assert kind(b" " * 5000 + shell) == "shell"
    assert kind(b"words " * 900 + shell) is None
    assert kind(b"a table and an outlet let go, let it be, let them") is None  # words of JavaScript without its punctuation
    assert kind(b"let a = 1;\nlet b = 2;\n") == "javascript"
    assert kind(b"SELECT 1\nFROM users\n") is None and kind(b"# build\nfrom base\nCOPY a b\nRUN it\n\nFROM x\n") == "dockerfile"
    assert kind(b"rules quote $_POST and $_GET here") is None and kind(b"$_POST['a']; ?>") == "php" and kind(b"<?xml version='1.0'?> $_POST $_GET") is None
    assert kind(b"- id: a\n- pattern: import os\nname: x\nkind: y\nmore: z\n") is None
    assert kind(b'{"pattern": "import os; base64.b64decode"}') is None
    assert kind(b"import os\nuse strict;\n") is None  # too near to each other
    assert kind(b"use") is None and kind(b"") is None
    assert decide_rows([None], [None], [None])[0] == [None]


def test_columns(spark):
    df = spark.createDataFrame([(1, b"use strict;\nmy $x;\n"), (2, None), (3, b"")], "id int, content binary")
    got = {r.id: (r.a, r.b) for r in df.select("id", languages.language(df.content).alias("a"), languages.scores(df.content).alias("b")).collect()}
    assert got == {1: ("perl", [("perl", 15)]), 2: (None, None), 3: (None, [])}
