"""Phrase collocations by growth of contiguous patterns from prefixes.

1. The words of each run of texts are counted there, then per language and word.
   A word has an id, a 64-bit hash of language and word; two words of one id are
   found where the counts meet, and all starts again with other ids.
2. Each occurrence of a frequent word is projected: the row (word, the words
   that follow it in its piece, up to the longest phrase's length), cut before
   the first word that isn't frequent.  A bitmap of fixed size tells which words
   are; a false hit costs a row and changes nothing.  Equal rows of a run of
   texts become one with a count, and rows travel to the task of their prefix as
   columns of ids.
3. A task sorts its rows, so the occurrences of a prefix lie in one range.
   `grow` extends a prefix to the right, depth first: each next word that is
   frequent in the range gives a phrase and a range to go on with.
4. A word is common if it has half of a task's rows and at least 1 / HOT of all
   words.  Common prefixes are parted: a row goes to the task of its shortest
   prefix that ends in a word that isn't common, or of the whole row, so no key
   has more rows than such a word.  Phrases with such a word, and whole rows, are
   counted in one place; phrases of common words alone come as partial counts
   from several tasks and are added up after.
5. Scores are integer divisions of 38-digit decimals.  A phrase is compared with
   the longer ones around it by grouping their parts, and each language's first
   are ranked in levels: salted parts, then parts of parts.

Null texts are empty, null languages `und`; doc_id is not read, and rows that
repeat count each.  A text that is one long piece, or one long word, is a row as
any other.  Other columns are not read, whatever their names.  An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.llm import textkit
from faktum.llm.storage import cut, table

_PART = np.zeros(256, bool)
_PART[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_GAP = _PART.copy()
_GAP[[0x20, 0x09]] = True
#: Texts are counted in runs of about this many bytes.
RUN_BYTES = 2 << 20
#: Projected rows of a task, at most about, and common words that are listed, at most.
ROWS_A_TASK, HOT = 1 << 18, 1 << 18
#: Places of the bitmap of frequent words.
PLACES = 1 << 24
#: Rows of a language that one task ranks, about.
RANKED = 1 << 16
SEEDS = 8


def _ids(h: np.ndarray, at: np.ndarray, langs: list[str], seed: int) -> np.ndarray:
    """Ids of the words; never 0, which stands for no word."""
    salt = {x: int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=bytes([seed])).digest(), "little") for x in set(langs)}
    out = textkit.mix64(h ^ np.array([salt[x] for x in langs], np.uint64)[at])
    return np.where(out == 0, textkit.U64(1), out)


def _runs(batches, seed: int):
    """For each run of texts: its bytes and languages; ids, text, bounds and piece of its words."""
    for batch in batches:
        buf, offsets = textkit.utf8(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for lo, hi in textkit.runs(offsets, RUN_BYTES):
            own, bounds = buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            h, at, start, end = textkit.located(own, bounds, _GAP)
            if len(h):
                piece = np.searchsorted(np.flatnonzero(_PART[own]), start)
                yield own, langs[lo:hi], _ids(h, at, langs[lo:hi], seed), at, start, end, piece


def _differs(buf: np.ndarray, start: np.ndarray, end: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Which words differ from the word numbered `other` of the same run."""
    size = end - start
    out = size != size[other]
    same = np.flatnonzero(~out)
    length = size[same]
    if len(same):
        place = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        unlike = textkit.fold(buf)[np.repeat(start[same], length) + place] != textkit.fold(buf)[np.repeat(start[other[same]], length) + place]
        out[same] = np.logical_or.reduceat(unlike, np.cumsum(length) - length)
    return out


def _counted(seed: int):
    def run(batches):
        for buf, langs, ids, at, start, end, _ in _runs(batches, seed):
            _, first, inverse, count = np.unique(ids, return_index=True, return_inverse=True, return_counts=True)
            odd = np.flatnonzero(_differs(buf, start, end, first[inverse]))
            folded = textkit.fold(buf)
            chosen, n = np.concatenate([first, odd]), np.concatenate([count, np.zeros(len(odd), np.int64)])
            words = [folded[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(start[chosen].tolist(), end[chosen].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids[chosen].view(np.int64)), pa.array([langs[k] for k in at[chosen].tolist()], pa.string()), pa.array(words, pa.string()), pa.array(n)], names=["id", "lang", "word", "n"])

    return run


def _dictionary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(id, lang, word, n) of every word, and the seed of the ids, which are different for all."""
    for seed in range(SEEDS):
        parts = docs.mapInArrow(textkit.tidy(_counted(seed)), "id long, lang string, word string, n long")
        own = F.struct("lang", "word")
        found = cut(parts.groupBy("id").agg(F.min(own).alias("own"), F.max(own).alias("last"), F.sum("n").alias("n")))
        if found.filter("own <> last").limit(1).count() == 0:
            return found.select("id", "own.lang", "own.word", "n"), seed
    raise ValueError("words share ids under every seed")


def _bitmap(frequent: DataFrame) -> np.ndarray:
    """PLACES bits, those of frequent ids set."""
    spot = frequent.select(F.pmod("id", F.lit(PLACES)).alias("p")).distinct()
    size = PLACES // 64
    rows = spot.groupBy(F.floor(F.col("p") / size).alias("k")).agg(F.collect_list((F.col("p") % size).cast("int")).alias("bits"))

    def pack(batches):
        for batch in batches:
            for k, bits in zip(batch.column("k").to_pylist(), batch.column("bits"), strict=True):
                flags = np.zeros(size, bool)
                flags[bits.values.to_numpy()] = True
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([np.packbits(flags).tobytes()])], names=["k", "bits"])

    out = np.zeros((64, size // 8), np.uint8)
    for row in rows.mapInArrow(pack, "k long, bits binary").collect():
        out[row["k"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def distinct_rows(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows, in ascending order, and how often each stands there."""
    values, rank = np.unique(rows, return_inverse=True)
    rank = rank.reshape(rows.shape)
    key, size = rank[:, 0], len(values)
    for column in range(1, rows.shape[1]):
        if size * len(values) >= 2**62:
            key = np.unique(key, return_inverse=True)[1]
            size = len(key)
        key, size = key * len(values) + rank[:, column], size * len(values)
    _, first, count = np.unique(key, return_index=True, return_counts=True)
    return rows[first], count


def _owner(rows: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """A hash of each row's shortest prefix that ends in a word that isn't common."""
    out = textkit.mix64(rows[:, 0])
    on = np.isin(rows[:, 0], hot)
    for column in range(1, rows.shape[1]):
        out[on] = textkit.mix64(out[on] * textkit.U64(0x9E3779B97F4A7C15) + rows[on, column])
        on &= np.isin(rows[:, column], hot)
    return out


def _projected(seed: int, bits: np.ndarray, hot: np.ndarray, tasks: int, longest: int):
    """(task, columns of ids, counts) of the occurrences of each run's frequent words with what follows them."""

    def run(batches):
        for _, _, ids, at, _, _, piece in _runs(batches, seed):
            spot = (ids & textkit.U64(PLACES - 1)).astype(np.int64)
            frequent = (bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8)) & 1 == 1
            rows = np.zeros((len(ids), longest), textkit.U64)
            alive = frequent.copy()
            rows[alive, 0] = ids[alive]
            for k in range(1, longest):
                on = np.zeros(len(ids), bool)
                on[: len(ids) - k] = alive[: len(ids) - k] & frequent[k:] & (at[k:] == at[: len(ids) - k]) & (piece[k:] == piece[: len(ids) - k])
                rows[on, k] = ids[np.flatnonzero(on) + k]
                alive = on
            rows = rows[rows[:, 1] != 0]
            if not len(rows):
                continue
            rows, count = distinct_rows(rows)
            task = _owner(rows, hot) % textkit.U64(tasks)
            order = np.argsort(task, kind="stable")
            task, rows, count = task[order].astype(np.int64), rows[order], count[order]
            first = np.concatenate([[0], np.flatnonzero(task[1:] != task[:-1]) + 1])
            last = [*first[1:].tolist(), len(task)]
            own = list(zip(first.tolist(), last, strict=True))
            made = [pa.array(task[first]), pa.array([np.ascontiguousarray(rows[a:b].T).tobytes() for a, b in own]), pa.array([count[a:b].astype("<u4").tobytes() for a, b in own])]
            yield pa.RecordBatch.from_arrays(made, names=["task", "rows", "counts"])

    return run


def grow(columns: np.ndarray, counts: np.ndarray, lo: int, hi: int, prefix: tuple[int, ...], least: int, hot: np.ndarray, whole: bool, out: list) -> None:
    """Extends `prefix`, whose occurrences are the sorted rows lo to hi, to the right: appends (phrase, count) for each
    phrase that has `least` occurrences, depth first.  Where `prefix` has common words only (`whole` is false), the rows
    may be some of its rows: then phrases of common words are all given, but for the longest, whose rows are never parted."""
    depth = len(prefix)
    own = columns[depth, lo:hi]
    first = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1])
    last = np.append(first[1:], hi - lo)
    total = np.add.reduceat(counts[lo:hi], first)
    words = own[first]
    all_here = np.ones(len(words), bool) if whole or depth + 1 == len(columns) else ~np.isin(words, hot)
    for k in np.flatnonzero((words != 0) & ((total >= least) | ~all_here)).tolist():
        phrase = (*prefix, int(words[k]))
        out.append((phrase, int(total[k])))
        if depth + 1 < len(columns):
            grow(columns, counts, lo + int(first[k]), lo + int(last[k]), phrase, least, hot, bool(all_here[k]), out)


def _grown(hot: np.ndarray, longest: int, least: int):
    common = set(hot.tolist())

    def run(group: pa.Table) -> pa.Table:
        raw = list(zip(group["rows"].to_pylist(), group["counts"].to_pylist(), strict=True))
        columns = np.concatenate([np.frombuffer(r, textkit.U64).reshape(longest, -1) for r, _ in raw], axis=1)
        counts = np.concatenate([np.frombuffer(c, "<u4") for _, c in raw]).astype(np.int64)
        order = np.lexsort(columns[::-1])
        columns, counts = columns[:, order], counts[order]
        first = np.concatenate([[0], np.flatnonzero(columns[0, 1:] != columns[0, :-1]) + 1])
        out: list = []
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(counts)], strict=True):
            prefix = int(columns[0, lo])
            grow(columns, counts, lo, hi, (prefix,), least, hot, prefix not in common, out)
        flat = np.array([x for phrase, _ in out for x in phrase], textkit.U64).view(np.int64)
        ends = np.cumsum([0] + [len(phrase) for phrase, _ in out]).astype(np.int32)
        return pa.table({"ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "a": pa.array([a for _, a in out], pa.int64())})

    return run


def frequent_phrases(docs: DataFrame, longest: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids, a) of the phrases of 2 to `longest` words that occur `least` times; (id, lang, word, n) of the frequent words;
    (lang, n) of all words."""
    docs = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"))
    words, seed = _dictionary(docs)
    totals = cut(words.groupBy("lang").agg(F.sum("n").alias("n")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    frequent = words.filter(F.col("n") >= least)
    common = frequent.filter(F.col("n") > max(ROWS_A_TASK // 2, n // HOT)).select("id").toArrow()["id"]
    hot = np.sort(common.to_numpy().view(textkit.U64))
    tasks = max(n // ROWS_A_TASK + 1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.mapInArrow(textkit.tidy(_projected(seed, _bitmap(frequent), hot, tasks, longest)), "task long, rows binary, counts binary")
    grown = rows.groupBy("task").applyInArrow(_grown(hot, longest, least), "ids array<long>, a long")
    return cut(grown.groupBy("ids").agg(F.sum("a").alias("a")).filter(F.col("a") >= least)), frequent, totals


def _scored(phrases: DataFrame, frequent: DataFrame) -> DataFrame:
    """ids, a and, of the cut that counts, l, r and score."""
    known = phrases.unionByName(frequent.select(F.array("id").alias("ids"), F.col("n").alias("a")))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.withColumn("left", F.slice("ids", F.lit(1), F.col("k"))).withColumn("right", F.slice("ids", F.col("k") + 1, F.size("ids") - F.col("k")))
    cuts = cuts.join(known.select(F.col("ids").alias("left"), F.col("a").alias("l")), "left").join(known.select(F.col("ids").alias("right"), F.col("a").alias("r")), "right")
    quotient = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    return cuts.groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct(quotient.alias("score"), "k", "l", "r")).alias("cut")).select("ids", "a", "cut.l", "cut.r", "cut.score")


def _inside_longer(phrases: DataFrame) -> DataFrame:
    """(ids, most): how often the commonest longer phrase around a phrase occurs."""
    sizes = F.sequence(F.lit(2), F.size("ids") - 1)
    spans = F.flatten(F.transform(sizes, lambda s: F.transform(F.sequence(F.lit(1), F.size("ids") - s + 1), lambda i: F.slice("ids", i, s))))
    return phrases.filter(F.size("ids") > 2).select(F.explode(spans).alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("most"))


def _first(rows: DataFrame, limit: int) -> DataFrame:
    """Each language's first `limit` by score, a and phrase, with their rank."""
    own = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    most = rows.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    size = max(RANKED, 2 * limit)
    salts = -(-most // size)
    while salts > 1:
        part = W.partitionBy("lang", F.pmod(F.hash("phrase"), F.lit(salts))).orderBy(*own)
        rows = rows.withColumn("rank", F.row_number().over(part)).filter(F.col("rank") <= limit).drop("rank")
        salts = -(-salts * limit // size)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*own)))
    return ranked.filter(F.col("rank") <= limit)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, inside: int = 50, limit: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first phrases of 2 to `longest` words."""
    phrases, frequent, totals = frequent_phrases(docs, longest, least)
    kept = _scored(phrases, frequent).join(_inside_longer(phrases), "ids", "left").filter(F.col("most").isNull() | (100 * F.col("most") < inside * F.col("a"))).drop("most")
    spelt = kept.select("ids", F.posexplode("ids").alias("place", "id")).join(frequent.select("id", "lang", "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("place", "word"))).alias("words"))
    spelt = spelt.select("ids", "lang", F.array_join(F.col("words.word"), " ").alias("phrase"))
    rows = cut(kept.join(spelt, "ids").drop("ids"))
    out = _first(rows, limit).join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS p FROM d)),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM p GROUP BY lang),
g AS MATERIALIZED (SELECT lang, w[i : i + k - 1] AS g, count(*) AS a FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 4) t(k) WHERE len(w) >= k) GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM g WHERE len(g) >= 2 AND a >= 10),
s AS (SELECT c.lang, c.g, c.a, min({'score': CAST(c.a AS HUGEINT) * c.a * 1000000 // (CAST(l.a AS HUGEINT) * r.a), 'k': k, 'l': l.a, 'r': r.a}) AS cut
      FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN g l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN g r ON r.lang = c.lang AND r.g = c.g[k + 1 :] GROUP BY ALL),
i AS (SELECT lang, part, max(a) AS most FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS part FROM c WHERE len(g) = 3) GROUP BY ALL),
k AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, s.a, cut.l AS l, cut.r AS r, CAST(cut.score AS BIGINT) AS score
      FROM s LEFT JOIN i ON i.lang = s.lang AND i.part = s.g WHERE most IS NULL OR 100 * most < 50 * s.a),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM k)
SELECT lang, rank, phrase, a, l, r, n, score FROM o JOIN n USING (lang) WHERE rank <= 2000
"""
