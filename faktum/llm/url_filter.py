"""URL filter: longest rule, else a character language-model ratio.

Rules are a host and the beginning of a path; a rule fits its host and all
subdomains if the url's path starts with the rule's, and the longest fitting
rule decides.  Urls without a rule are judged by two variable-order Markov
models over the bytes of host and path, of the urls that rules accept and of
those they reject: the difference of log-likelihoods divided by the length is
compared with a threshold that separates rule-judged urls best (each half of
them is scored by models of the other half).

The models are fitted on all different rule-judged urls.  Tasks count their
grams, which Spark adds up; the driver gets a row for each different gram, and
the threshold is found by counts of bins of the differences, of which only
those that can hold it are looked into.  Up to HERE urls are fitted on the
driver, with the same result.  Nulls: a null url, or one without `://`, has an empty
host and path, and is judged by the models like any url (an empty one has the
difference 0).  Without rule-judged urls of both kinds every other url is
allowed.  Urls that repeat are judged alike; an empty table gives an empty
result; other columns are never read.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.llm import grams, textkit
from faktum.llm.storage import cut, table

ORDER, TAU = 6, 1.0
#: Urls that the driver fits itself, or finds the last of the threshold among; bins of differences in a round.
HERE, BINS = 65_536, 1024
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def ruled(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(the longest rule that fits, its verdict), or nulls."""
    rule = verdict = None
    for action, text in sorted(rules, key=lambda x: -len(x[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(f"/{rest}")
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, action) if verdict is None else verdict.when(fits, action)
    null = F.lit(None).cast("string")
    return (rule if rule is not None else null), (verdict if verdict is not None else null)


def threshold(x: np.ndarray, y: np.ndarray) -> float:
    """The cut of x with the least mean of the two classes' error rates; y: whether accepted."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(bool)
    missed = np.concatenate([[0], np.cumsum(y)]) / max(1, y.sum())
    passed = 1 - np.concatenate([[0], np.cumsum(~y)]) / max(1, (~y).sum())
    edges = np.concatenate([[x[0] - 1], (x[1:] + x[:-1]) / 2, [x[-1] + 1]])
    distinct = np.concatenate([[True], x[1:] != x[:-1], [True]])
    cost = np.where(distinct, missed + passed, np.inf)
    return float(edges[int(np.argmin(cost))])


def difference(fitted: grams.Table, texts: pa.Array) -> np.ndarray:
    sums, sizes = fitted.sums(texts)
    return (sums[:, 1] - sums[:, 0]) / np.maximum(sizes, 1)


def _counts(urls: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The different grams of all urls with their counts by half and verdict, added up by Spark."""
    names = [f"w{k}" for k in range(4)]

    def run(batches):
        for batch in batches:
            kind = batch.column("y").to_numpy(zero_copy_only=False) + 2 * batch.column("half").to_numpy(zero_copy_only=False)
            keys, weights = grams.counts(batch.column("text"), kind.astype(np.int64), 4, ORDER)
            yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), *(pa.array(weights[:, k].astype(np.int64)) for k in range(4))], names=["gram", *names])

    parts = urls.mapInArrow(textkit.tidy(run), "gram long, " + ", ".join(f"{x} long" for x in names))
    data = parts.groupBy("gram").agg(*(F.sum(x).alias(x) for x in names)).toPandas()
    return grams.tally(data["gram"].to_numpy(np.int64).astype(np.uint64), data[names].to_numpy(np.float64))


def _models(keys: np.ndarray, weights: np.ndarray) -> tuple[grams.Table, list[grams.Table]]:
    """(the models of all urls, for each half the models of the other)."""
    return grams.markov(keys, weights[:, :2] + weights[:, 2:], ORDER, TAU), [grams.markov(keys, weights[:, 2 - 2 * h : 4 - 2 * h], ORDER, TAU) for h in (0, 1)]


def _crossed(others: list[grams.Table], texts: pa.Array, half: np.ndarray) -> np.ndarray:
    x = np.zeros(len(half))
    for h, other in enumerate(others):
        own = np.flatnonzero(half == h)
        x[own] = difference(other, texts.take(pa.array(own)))
    return x


def _bins(scored: DataFrame, edges: np.ndarray) -> tuple[np.ndarray, ...]:
    """(accepted, rejected, least, greatest) of each bin that has rows, ascending; an edge is a bin of its own."""

    def run(batches):
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y"))
            at = np.searchsorted(edges, x)
            own, at = np.unique(2 * at + (edges[np.minimum(at, len(edges) - 1)] == x), return_inverse=True)
            least, greatest = np.full(len(own), np.inf), np.full(len(own), -np.inf)
            np.minimum.at(least, at, x)
            np.maximum.at(greatest, at, x)
            ones = np.bincount(at, weights=y, minlength=len(own)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own.astype(np.int64), ones, np.bincount(at, minlength=len(own)).astype(np.int64) - ones, least, greatest)], names=["bin", "a", "r", "lo", "hi"])

    parts = scored.mapInArrow(run, "bin long, a long, r long, lo double, hi double")
    data = parts.groupBy("bin").agg(F.sum("a").alias("a"), F.sum("r").alias("r"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas().sort_values("bin")
    return tuple(data[c].to_numpy() for c in ("a", "r", "lo", "hi"))


def threshold_of(scored: DataFrame, here: int | None = None) -> float:
    """`threshold` of the columns x and y, of any number of rows.

    A bin without a cost below, or equal to, the best of the bins' borders (its own least possible one: all that it
    rejects passed over, none that it accepts missed) needs not be looked into.
    """
    here, inside, edges = HERE if here is None else here, scored, np.zeros(0)
    while True:
        found = inside.approxQuantile("x", [k / BINS for k in range(BINS + 1)], 0.2 / BINS)
        edges = np.unique(np.concatenate([edges, found]))
        a, r, lo, hi = _bins(scored, edges)
        missed, passed = (np.concatenate([[0], np.cumsum(n)]) / max(1, n.sum()) for n in (a, r))
        cost = missed + (1 - passed)
        open_ = np.flatnonzero((lo < hi) & (missed[:-1] + (1 - passed[1:]) <= cost.min()))
        left, right = lo[open_], hi[open_]

        def held(batches, left=left, right=right):
            for batch in batches:
                x = batch.column("x").to_numpy(zero_copy_only=False)
                at = np.maximum(np.searchsorted(left, x, "right") - 1, 0)
                yield batch.filter(pa.array((x >= left[at]) & (x <= right[at])))

        inside = scored.mapInArrow(held, scored.schema) if len(open_) else None
        if inside is None or (a + r)[open_].sum() <= here:
            break
    # (cost, place) of the borders and of what stands between the rows of open bins
    places = np.concatenate([[lo[0] - 1], (lo[1:] + hi[:-1]) / 2, [hi[-1] + 1]])
    best = [(float(cost[k]), float(places[k])) for k in (int(np.argmin(cost)),)]
    if inside is not None:
        data = inside.toPandas().sort_values("x", kind="stable")
        x, y = data["x"].to_numpy(), data["y"].to_numpy()
        starts, ends = np.searchsorted(x, left), np.searchsorted(x, right, "right")
        before = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(r)])
        for k, start, end in zip(open_, starts, ends, strict=True):
            own, ones = x[start:end], y[start:end].astype(bool)
            here_a, here_r = before[0][k] + np.cumsum(ones), before[1][k] + np.cumsum(~ones)
            between = np.flatnonzero(own[1:] != own[:-1])
            costs = here_a[between] / max(1, a.sum()) + (1 - here_r[between] / max(1, r.sum()))
            at = int(np.argmin(costs))
            best.append((float(costs[at]), float((own[between[at]] + own[between[at] + 1]) / 2)))
    return min(best)[1]


def fit(rows: DataFrame, here: int | None = None) -> tuple[grams.Table | None, float]:
    """rows: address string, verdict string.  The models (rejected, accepted) and the threshold, of all different urls that rules judge."""
    rows = rows.select(F.col("address").alias("text"), F.when(F.col("verdict") == "allow", 1).when(F.col("verdict") == "block", 0).alias("y")).filter("y IS NOT NULL")
    hash_ = F.xxhash64("text")
    urls = cut(rows.distinct().select("text", "y", hash_.alias("hash"), hash_.bitwiseAND(1).alias("half")))
    kinds = {x["y"]: x["n"] for x in urls.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(kinds) < 2:
        return None, 0.0
    if sum(kinds.values()) <= max(8, HERE if here is None else here):
        data = urls.toPandas().sort_values(["hash", "text", "y"])
        texts, y = pa.array(data["text"].tolist(), pa.string()), data["y"].to_numpy(np.int64)
        half = (np.arange(len(y)) // 2) % 2 if len(y) < 8 else data["half"].to_numpy(np.int64)
        model, others = _models(*grams.counts(texts, y + 2 * half, 4, ORDER))
        return model, threshold(_crossed(others, texts, half), y)
    model, others = _models(*_counts(urls.select("text", "y", "half")))
    sent = urls.sparkSession.sparkContext.broadcast(others)

    def run(batches):
        for batch in batches:
            x = _crossed(sent.value, batch.column("text"), batch.column("half").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([pa.array(x), batch.column("y")], names=["x", "y"])

    return model, threshold_of(cut(urls.mapInArrow(textkit.tidy(run), "x double, y int")), here)


JUDGED_DDL = "page_id long, host string, path string, rule string, verdict string, difference double"


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and difference (null where a rule decides) for every row of pages (page_id, url)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = ruled(rules, F.col("host"), F.col("path"))
    rows = rows.withColumn("rule", rule).withColumn("verdict", verdict).withColumn("address", F.concat("host", "path"))
    model = pages.sparkSession.sparkContext.broadcast(fit(rows))

    def run(batches):
        fitted, least = model.value
        for batch in batches:
            verdicts = batch.column("verdict").to_pylist()
            free = np.array([v is None for v in verdicts], bool)
            x = np.zeros(len(verdicts))
            if fitted is not None and free.any():
                x[free] = difference(fitted, batch.column("address").filter(pa.array(free)))
            verdicts = [v or ("allow" if fitted is None or d >= least else "block") for v, d in zip(verdicts, x, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path", "rule")), pa.array(verdicts, pa.string()), pa.array(x, mask=~free)], names=["page_id", "host", "path", "rule", "verdict", "difference"])

    return rows.mapInArrow(textkit.tidy(run), JUDGED_DDL)


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
