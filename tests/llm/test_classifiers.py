import math
import re
import zlib

import numpy as np
import pyarrow as pa

from faktum.llm import grams, language_id, toxicity, url_filter
from faktum.llm.language_id import Evidence, judged, keep_known, of_documents, of_pages, op3_language_id
from faktum.llm.toxicity import keep_ordinary, op8_toxicity
from faktum.llm.url_filter import RULES, judge, op2_url_filter

SF = "/root/testdata/sf0.001"
TEXTS = ["the cat sat", "the mat", "A cat", "", "dog dog dog", "the dog"]


def plain(counts, order, context, symbol, kind, c, shared):
    """P(symbol | context) of class c by the formulas, recursively."""
    gram = context[len(context) - order + 1 :] + symbol if order > 1 else symbol
    if order == 0:
        return 1 / 256
    own = {g: n for g, n in counts[order].items() if g[:-1] == gram[:-1]}
    total = sum(n[c] for n in own.values())
    n = own.get(gram, (0, 0))[c]
    lower = plain(counts, order - 1, context, symbol, kind, c, shared)
    if kind == "markov":
        return (n + shared * lower) / (total + shared)
    if not total:
        return lower
    left = {g: max(v[c] - grams.DISCOUNT * min(v[c], 1), 0) for g, v in own.items()}
    return left.get(gram, 0) / total + max(1 - sum(left.values()) / total, 1e-9) * lower


def test_tables_equal_the_formulas():
    order, classes = 3, np.array([0, 1, 0, 1, 0, 1])
    keys, weights = grams.counts(pa.array(TEXTS), classes, 2, order)
    padded = [b" " * (order - 1) + t.lower().encode() for t in TEXTS]
    top = {}
    for t, c in zip(padded, classes, strict=True):
        for i in range(order - 1, len(t)):
            g = t[i - order + 1 : i + 1]
            own = top.setdefault(g, [0, 0])
            own[c] += 1
    for kind, fitted, shared in (("markov", grams.markov(keys, weights, order, 2.0), 2.0), ("kn", grams.kneser_ney(keys, weights, order, 0.3), 0.3)):
        counts = {order: {g: tuple(n) for g, n in top.items()}}
        for k in range(order - 1, 0, -1):
            lower, seen = {}, {}
            for g, n in counts[k + 1].items():
                base = n if kind == "markov" else [float(x > 0) for x in (top[g] if k + 1 == order else raw[g])]
                own = lower.setdefault(g[1:], [0.0, 0.0, 0.0])
                for c in (0, 1):
                    own[c] += base[c]
                own[2] += 1
            raw = {g: n[:2] for g, n in lower.items()}
            counts[k] = {g: tuple(n[:2]) if kind == "markov" else (n[0] + shared * n[2], n[1] + shared * n[2]) for g, n in lower.items()}
        for text in ("the cat", "zzz", "dog sat!", "a"):
            got = fitted.sums(pa.array([text]))[0][0]
            own = b" " * (order - 1) + text.encode()
            logs = [[math.log(plain(counts, order, own[i - order + 1 : i], own[i : i + 1], kind, c, shared)) for i in range(order - 1, len(own))] for c in (0, 1)]
            want = [sum(logs[0]), sum(logs[1])] if kind == "markov" else [sum(logs[1]) - sum(logs[0])]
            assert np.allclose(got, want, rtol=1e-4, atol=1e-4), (kind, text)


def test_greatest_passage_and_score(spark):
    """Scores by the definition: byte after byte, passage after passage."""
    docs, labels, truth = made_up(spark, 240)
    model = toxicity.fit(docs, labels)
    taught = [r for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    keys, weights = grams.counts(pa.array([r.text for r in taught]), np.array([truth[r.doc_id] for r in taught]), 2, toxicity.ORDER)
    table = grams.kneser_ney(keys, weights, toxicity.ORDER, toxicity.SHARED)
    has = [set(re.findall(r"[a-z0-9]+", r.text)) for r in taught]
    n = [{w: sum(w in own for own, r in zip(has, taught, strict=True) if truth[r.doc_id] == c) for w in set().union(*has)} for c in (0, 1)]
    kinds, total = [sum(x > 0 for x in own.values()) for own in n], [sum(own.values()) for own in n]

    def word(w):
        both = sum(own.get(w, 0) for own in n)
        p = []
        for c in (0, 1):
            lower = ((n[c].get(w, 0) > 0) + toxicity.SHARED * both + 0.5) / (kinds[c] + toxicity.SHARED * sum(total) + 0.5 * (len(n[c]) + 1))
            p.append(max(n[c].get(w, 0) - grams.DISCOUNT, 0) / total[c] + grams.DISCOUNT * kinds[c] / total[c] * lower)
        return math.log(p[1] / p[0])

    texts = [r.text for r in docs.limit(20).collect()] + ["", "short", "exactly sixteen.", "é" * 40, "..., !!", "blixx--Ha"]
    for text in texts:
        own = b" " * (toxicity.ORDER - 1) + text.lower().encode()
        grown = [int.from_bytes(own[i : i + toxicity.ORDER], "big") for i in range(len(own) - toxicity.ORDER + 1)]
        values = [float(table.of(np.array([g], np.uint64))[0, 0]) for g in grown]
        size = min(len(values), toxicity.PASSAGE)
        want = [max((sum(values[i : i + size]) / size for i in range(len(values) - size + 1)), default=0.0) if size else 0.0, max(map(word, re.findall(r"[a-z0-9é]+", text.lower())), default=0.0)]
        assert np.allclose(model.differences(pa.array([text]))[0], want, atol=1e-5), text
        assert np.isclose(model.score(pa.array([text]))[0], 1 / (1 + math.exp(-(model.weights @ want + model.offset))), atol=1e-4)
    assert np.allclose(model.differences(pa.array(texts)), [model.differences(pa.array([t]))[0] for t in texts], atol=1e-6)


# urls

URLS = [
    "http://a.example.com/en/12", "https://EXAMPLE.com/en/7", "http://www.example.com/en/71?x=/de/", "ftp://x.net/de/", "http://example.net/de/8", "http://notexample.net/de/81", "http://x.org/es", "http://x.org/es/#f", "x.org/es/", None, "", "http://", "a://b://c/en/",
    "http://com/en/", "http://telecom/en/", "http://h?/com/en/", "http://h#x/y", "ht\ntp://h\n.com/en/\nx", "http://É.COM/en/",
]


def by_hand(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].partition("?")[0].partition("#")[0]
    fits = [(len(r), r, v) for v, r in RULES if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    rows = [(i, u) for i, u in enumerate(URLS)]
    got = judge(spark.createDataFrame(rows, "page_id long, url string").selectExpr("page_id", "url", "1 AS host", "2 AS verdict")).collect()
    for r in got:
        host, path, rule, verdict = by_hand(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
        assert (r.difference is None) == (rule is not None)
    assert judge(spark.createDataFrame([], "page_id long, url string")).collect() == []


def test_rules_are_those_of_the_contract(spark):
    """Word for word, so that neither a swapped word nor a swapped order passes."""
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    assert RULES == tuple(tuple(x.split(" ")) for x in contract.split(", "))
    urls = [("http://x.net/de/1", "net/de/", "allow"), ("http://example.net/de/7", "net/de/", "allow"), ("http://a.example.net/de/81", "example.net/de/8", "block"), ("http://b.com/en/7", "com/en/", "block"), ("http://example.com/en/7", "example.com/en/7", "allow"), ("http://x.org/es/", "org/es/", "block")]
    got = judge(spark.createDataFrame([(i, u) for i, (u, _, _) in enumerate(urls)], "page_id long, url string")).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == [(i, *want) for i, (_, *want) in enumerate(urls)]


def test_urls_equal_brute_force(spark):
    larger = "/root/testdata/sf0.01"
    rows = {r.page_id: r for r in op2_url_filter(spark, larger).collect()}
    pages = spark.read.parquet(f"{larger}/pages.parquet").collect()
    assert len(rows) == len(pages)
    taught = sorted({(by_hand(p.url)[0] + by_hand(p.url)[1], by_hand(p.url)[3]) for p in pages if by_hand(p.url)[3]})
    keys, weights = grams.counts(pa.array([t for t, _ in taught]), np.array([int(v == "allow") for _, v in taught]), 2, url_filter.ORDER)
    fitted = grams.markov(keys, weights, url_filter.ORDER, url_filter.TAU)
    free = [p for p in pages if by_hand(p.url)[3] is None]
    x = url_filter.difference(fitted, pa.array(["".join(by_hand(p.url)[:2]) for p in free]))
    allowed = [rows[p.page_id].difference for p in free if rows[p.page_id].verdict == "allow"]
    blocked = [rows[p.page_id].difference for p in free if rows[p.page_id].verdict == "block"]
    assert np.allclose([rows[p.page_id].difference for p in free], x)
    assert not allowed or not blocked or min(allowed) >= max(blocked)
    for p in pages:
        if by_hand(p.url)[3]:
            assert (rows[p.page_id].rule, rows[p.page_id].verdict) == by_hand(p.url)[2:]


def test_models_are_fitted_on_all_urls(spark, monkeypatch):
    """Spread over tasks the fit is what the driver's is, and no url is left out, however many there are."""
    rand = np.random.default_rng(5)
    words = ["a", "bcd", "shop", "news", "en", "de"]
    rows = [("".join(f"/{words[i]}{rand.integers(40)}" for i in rand.integers(0, 4 if k % 3 else 6, 3)), "allow" if k % 3 else "block") for k in range(3000)]
    frame = spark.createDataFrame([*rows, *rows[:50], ("x", None)], "address string, verdict string").repartition(3)
    model, least = url_filter.fit(frame)
    monkeypatch.setattr(url_filter, "BINS", 16)
    spread, at = url_filter.fit(frame, 100)
    assert at == least and all(np.array_equal(model.keys[k], spread.keys[k]) and np.array_equal(model.value[k], spread.value[k]) for k in model.keys)
    keys, _ = grams.counts(pa.array(sorted({t for t, _ in rows})), np.zeros(len({t for t, _ in rows}), np.int64), 1, url_filter.ORDER)
    assert np.array_equal(keys, model.keys[url_filter.ORDER])


def test_threshold_of_bins(spark, monkeypatch):
    """Equal to that of arrays, with many equal values and many equal costs."""
    monkeypatch.setattr(url_filter, "BINS", 4)
    rand = np.random.default_rng(9)
    for n, digits in ((40, 0), (400, 1), (400, 9)):
        y = rand.integers(0, 2, n)
        x = np.round(rand.normal(0, 1, n) + y * 0.7, digits)
        scored = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y, strict=True)], "x double, y int")
        assert url_filter.threshold_of(scored, 20) == url_filter.threshold(x, y)


def test_threshold():
    x, y = np.array([1.0, 2, 3, 4]), np.array([0, 0, 1, 1])
    assert url_filter.threshold(x, y) == 2.5
    assert url_filter.threshold(np.array([1.0, 1, 1]), np.array([0, 1, 1])) in (0.0, 2.0)


# languages


def test_languages(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op3_language_id(spark, SF).collect()
    assert len(got) == len(lang)
    assert sum(r.language == lang[r.doc_id] for r in got) >= 0.98 * len(got)
    assert all(r.kept for r in got if r.language == lang[r.doc_id])


def posteriors(rows, model):
    """{row number: (language, posterior)} by the definition, for rows of (text, declared, host, suffix)."""
    names = [*model.languages, language_id.UNKNOWN]
    logs = [model.texts(pa.array([t or ""]))[0] for t, *_ in rows]
    said = [int(np.argmax(x)) if x.max() < 0 else None for x in logs]
    size, kappa = len(names), language_id.KAPPA
    site = lambda h: ".".join(h.split(".")[-2:])
    at = lambda own, of: [sum(1 for r, l in zip(rows, said, strict=True) if l == i and of(r) == own) for i in range(size)]
    every = at(0, lambda r: 0)
    corpus = [(n + 1) / (sum(every) + size) for n in every]
    out = {}
    for k, (text, declared, host, suffix) in enumerate(rows):
        if not text and declared is None and host is None and suffix is None:
            out[k] = (language_id.UNKNOWN, 0.0)
            continue
        if host is None or not any(at(host, lambda r: r[2])):
            prior = corpus
        else:
            own, near = at(host, lambda r: r[2]), at(site(host), lambda r: r[2] and site(r[2]))
            prior = [(n + kappa * (m + kappa * c) / (sum(near) + kappa)) / (sum(own) + kappa) for n, m, c in zip(own, near, corpus, strict=True)]
        sums = logs[k] + np.log(prior)
        for value, place in ((declared, 1), (suffix, 3)):
            if value is not None:
                kinds = len({r[place] for r, l in zip(rows, said, strict=True) if r[place] is not None and l is not None}) + 1
                all_ = [sum(1 for r, l in zip(rows, said, strict=True) if l == i and r[place] is not None) for i in range(size)]
                sums = sums + np.log([(n + 0.5) / (t + 0.5 * kinds) for n, t in zip(at(value, lambda r: r[place]), all_, strict=True)])
        p = np.exp(sums - sums.max())
        out[k] = (names[int(np.argmax(p))], p.max() / p.sum())
    return out


def test_posteriors_equal_the_definition(spark, monkeypatch):
    F = language_id.F
    docs = [(r.text[:300], r.lang, r.doc_id) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    rows = [(t, [l, None, "xx"][i % 3 if i % 7 else 0], [None, "a.b.com", "c.b.com", "b.com", f"h{i}.org"][i % 5], [None, "com", l][i % 3]) for i, (t, l, i) in enumerate(docs)]
    rows += [(None, None, None, None), ("", None, "a.b.com", None), (None, "de", None, None), ("12 34 !!", None, None, "zz"), ("le", None, "new.net", None)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, text string, declared string, host string, suffix string")
    evidence = Evidence(F.col("text"), F.col("declared"), F.col("host"), F.col("suffix"))
    want = posteriors(rows, language_id.fit(df, evidence))
    for most in (language_id.BROADCAST_ROWS, 0):  # by broadcast and by salted shuffle
        monkeypatch.setattr(language_id, "BROADCAST_ROWS", most)
        got = judged(df, evidence, [F.col("k")]).collect()
        assert len(got) == len(rows)
        for r in got:
            assert np.isclose(r.posterior, want[r.row.k][1], atol=1e-5), (rows[r.row.k], r, want[r.row.k])
            assert r.language == want[r.row.k][0] or r.posterior < 0.6


def test_text_outweighs_a_wrong_declaration(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    wrong = docs.filter("lang = 'fr' AND n_chars > 300").limit(3).collect()
    changed = docs.selectExpr("doc_id", "text", f"CASE WHEN doc_id IN ({', '.join(str(r.doc_id) for r in wrong)}) THEN 'en' ELSE lang END AS lang", "source", "n_chars")
    from pyspark.sql import functions as F

    got = {r.row.doc_id: r.language for r in judged(changed, of_documents(), [F.col("doc_id")]).collect()}
    assert all(got[r.doc_id] == "fr" for r in wrong)


def test_pages_and_odd_documents(spark):
    from pyspark.sql import functions as F

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = judged(pages, of_pages(), [F.col("page_id"), F.regexp_extract("html", 'lang="(..)"', 1).alias("lang")]).collect()
    assert len(got) == pages.count() and sum(r.language == r.row.lang for r in got) >= 0.9 * len(got)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source").withColumn("texts", F.lit(1)).withColumn("host", F.lit("x"))
    odd = spark.createDataFrame([(-1, None, None, None), (-2, "", None, None), (-3, None, "en", "src1"), (-4, "7 7 7 7 7 7 7 7 0 0 0 12 9 81 82 123 1 2 3", None, None), (None, "and the", "en", None)], "doc_id long, text string, lang string, source string")
    odd = odd.withColumn("texts", F.lit(1)).withColumn("host", F.lit("x"))
    kept = keep_known(docs.unionByName(odd))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {-1, -2, -4} and {-3, None} <= ids
    assert keep_known(docs.limit(0)).collect() == []
    assert keep_known(docs.withColumn("lang", F.lit(None).cast("string"))).collect() == []


def test_every_declared_language_is_known(spark):
    rng = np.random.default_rng(7)
    rows, names = [], [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    for k, name in enumerate(names):
        letters = rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 8, replace=False)
        words = ["".join(rng.choice(letters, 5)) for _ in range(30)]
        rows += [(100 * k + i, " ".join(rng.choice(words, 40)), [name, f"{name.upper()}-us", f"{name}_x"][i % 3], "h") for i in range(4 if k < 69 else 1)]
    got = keep_known(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).count()
    assert got == len(rows)
    judgements = judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), of_documents(), [language_id.F.col("doc_id")]).collect()
    assert sum(r.language == names[r.row.doc_id // 100] for r in judgements) >= 0.98 * len(rows)
    assert {r.language for r in judgements if r.row.doc_id == 6900} == {names[69]}


# toxicity


def made_up(spark, n=600):
    rng = np.random.default_rng(4)
    stems = ["ha", "mo", "ri", "ta", "lu", "en", "so", "vi"]
    word = lambda: "".join(rng.choice(stems, 3))
    docs, labels = [], []
    for i in range(n):
        toxic = int(i % 6 == 0)
        words = [word() for _ in range(int(rng.integers(5, 80)))]
        if toxic:
            for _ in range(1 + len(words) // 20):
                words[int(rng.integers(len(words)))] = str(rng.choice(["zwog" + word(), "blixx"]))
        docs.append((i, " ".join(words), i))
        labels.append((i, toxic))
    return spark.createDataFrame(docs, "doc_id long, text string, score int"), spark.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_toxicity_on_held_out_rows(spark):
    docs, labels, truth = made_up(spark)
    got = toxicity.score(docs, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(held) > 80
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    # held-out labels are no input
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert {tuple(r) for r in toxicity.score(docs, flipped).collect()} == {tuple(r) for r in got}
    kept = keep_ordinary(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in got if r.score < 0.5}


def test_toxicity_of_odd_rows(spark):
    docs, labels, _ = made_up(spark, 200)
    odd = spark.createDataFrame([(None, "blixx", 1), (-1, None, 1), (-1, "", 1), (-2, "blixx " * 50_000, 1)], docs.schema)
    more = spark.createDataFrame([(None, 1), (5, None), (3, 0), (3, 0)], labels.schema)
    got = toxicity.score(docs.unionByName(odd), labels.unionByName(more)).filter("doc_id IS NULL OR doc_id < 0").collect()
    assert len(got) == 4 and max(got, key=lambda r: r.score).score > 0.5
    assert toxicity.score(docs.limit(0), labels).collect() == []
    for own, want in ((labels.limit(0), 0.0), (labels.filter("toxic = 1"), 1.0)):
        assert {r.score for r in toxicity.score(docs, own).collect()} == {want}


def test_whole_table(spark):
    assert op8_toxicity(spark, SF).count() == 200


def test_rare_tags_are_one_language(spark, monkeypatch):
    """Tags below the share are pooled, their texts are kept, and a text that stands in a third of all rows is sampled once."""
    monkeypatch.setattr(language_id, "RARE", 20)
    rng = np.random.default_rng(2)
    words = {x: [f"{x}{''.join(chr(97 + c) for c in rng.integers(0, 26, 4))}" for _ in range(40)] for x in ("aa", "bb", "odd")}
    text = lambda x: " ".join(rng.choice(words[x], 30))
    rows = [(i, text("aa"), "en", "s") for i in range(60)] + [(100 + i, text("bb"), "de", "s") for i in range(60)] + [(200 + i, text("odd"), f"x{i}", "t") for i in range(6)]
    rows += [(300 + i, rows[0][1], "en", "s") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    assert language_id.fit(df, of_documents()).languages == ["de", "en", language_id.OTHER]
    got = {r.row.doc_id: r.language for r in judged(df, of_documents(), [language_id.F.col("doc_id")]).collect()}
    assert all(got[i] == {0: "en", 1: "de", 2: language_id.OTHER, 3: "en"}[i // 100] for i in got)
    assert keep_known(df).count() == len(rows)


def test_pages_query(spark):
    got = language_id.pages_language_id(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and sum(r.kept for r in got) >= 0.9 * len(got)
