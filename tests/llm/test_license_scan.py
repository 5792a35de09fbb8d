import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from faktum.llm import license_scan
from faktum.llm.license_scan import BASE, NAMES, NOTICES, Template, op11_license_scan, scan

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def places(own, phrase):
    phrase = words(phrase)
    return [i for i in range(len(own) - len(phrase) + 1) if own[i : i + len(phrase)] == phrase]


def digest(text, notices=()):
    """All columns by looking at every place; `notices` are those that the text was made with, whole."""
    own = words(text)
    base = {t.text: places(own, t.text) for t in BASE}
    starts = [x for found in base.values() for x in found]
    labels = {t.label for t in BASE + NAMES if places(own, t.text)} | {t.label for t in notices}
    sizes = [len(words(t.text)) for t in [*(t for t in BASE + NAMES if places(own, t.text)), *notices]]
    return len(own), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({t.label for t in BASE if base[t.text]})), ",".join(sorted(labels)), pytest.approx(max((n / (n + 2) for n in sizes), default=0.0))


def op11(spark, rows, tmp_path):
    spark.createDataFrame(rows, "doc_id long, text string, places string, found long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return {(r[0], *r[1:7]): r[7] for r in op11_license_scan(spark, str(tmp_path)).collect()}


def test_documents_equal_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    got = op11_license_scan(spark, SF).collect()
    assert len(got) == len(texts) and sum(r.n_base for r in got) > 0
    for r in got:
        assert tuple(r)[1:] == digest(texts[r.doc_id])


@pytest.mark.parametrize("run", [200, 1 << 21])
def test_made_texts_equal_brute_force(spark, monkeypatch, tmp_path, run):
    """Odd rows, phrases over line breaks and across rows, long texts, repeats; whole notices with words around them."""
    monkeypatch.setattr(license_scan, "RUN_BYTES", run)
    rng = np.random.default_rng(9)
    parts = ["MIT", "License", "license,", "apache", "Apache-License", "general public", "lesser", "é", "İ", "Ünit", "mit\nlicense", "x_y", "cc-by", "gnu", "0bsd"]
    rows = [(i, " ".join(rng.choice(parts, rng.integers(0, 40)))) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "mit"), (503, "license"), (None, "MIT license"), (504, "mit license"), (504, "mit license"), (505, "emit license mit licenses"), (506, "mit license " * 60_000), (507, "a" * 300_000 + " gnu general public license")]
    made = {600 + k: (("before it " * k) + t.text.replace(",", ",\n * ") + " and after it", (t,)) for k, t in enumerate(NOTICES)}
    rows += [(i, text) for i, (text, _) in made.items()]
    got = sorted(op11(spark, [(i, t, "p", 1) for i, t in rows], tmp_path).items(), key=str)
    seen = {}
    for key, score in got:
        seen.setdefault(key[0], []).append((*key[1:], score))
    for i, text in rows:
        if i in made and made[i][1][0].label in ("mit", "bsl"):
            continue  # their notices share most of their words
        assert all(x == digest(text, made[i][1] if i in made else ()) for x in seen[i]), i
    assert seen[600][0][5] == "mit" and "bsl" in seen[608][0][5]


def test_notices_with_changes(spark):
    """Changed, shortened and repeated notices are found where they stand; texts that only share words are not."""
    mit = NOTICES[0].text.split()
    changed = " ".join(w for k, w in enumerate(mit) if k % 11 != 9)
    named = " ".join(mit[:30] + ["Copyright", "holders", "of", "Example", "Inc"] + mit[30:])
    mixed = " ".join(np.random.default_rng(1).permutation(mit))
    rows = [(1, "x " * 100 + changed), (2, named), (3, mixed), (4, " ".join(mit[:14])), (5, NOTICES[0].text + " gap " * 200 + NOTICES[0].text), (6, "permission is granted to use the software without limitation " * 30)]
    got = {r.doc_id: [(x.label, x.places) for x in r.found if x.label == "mit"] for r in scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] and abs(got[1][0][1][0] - 100) <= license_scan.SLACK
    assert got[2] == [("mit", got[2][0][1])] and got[2][0][1][0] <= license_scan.SLACK
    assert not got[3] and not got[4] and not got[6]
    assert len(got[5][0][1]) == 2


def test_own_templates_and_empty_table(spark):
    df = spark.createDataFrame([(1, "All rights reserved. all RIGHTS reserved")], "doc_id long, text string")
    own = (Template("own", "all rights reserved"),)
    assert [r.found for r in scan(df, own).collect()] == [[(0, "own", [0, 3], 1.0)]]
    assert scan(df.limit(0), own).collect() == []
