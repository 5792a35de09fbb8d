"""Toxicity by class-conditional Kneser-Ney models.

A whole text is judged by its most telling passage, as a few words make it
toxic however long it is.  Models of toxic and of ordinary texts are compared
at two levels: over bytes, where a passage has PASSAGE bytes in a row and the
difference of the log-likelihoods is divided by their number; and over words,
where it is one word.  The first knows expressions with changing endings, the
second those that are spelled like ordinary ones.  Rare expressions are
smoothed through back-off counts that both classes share.  A logistic curve of
the two greatest differences makes a probability, 0.5 at the cut that is right
most often.

The models are fitted on a bounded sample of labelled rows: of each class about
SAMPLE, those whose doc_id has the least hashes, among those whose
crc32(doc_id as text) mod 5 is not 0.  The curve is fitted on the same rows,
each of PARTS parts scored by models of the other parts, and weighted to the
classes' shares in all labels of those folds.  ORDER, SHARED and PASSAGE were
chosen by such cross-scoring, without the held-out fold.

Nulls: a null text is empty (and has the difference 0); rows with a null
doc_id are scored but never learnt from; labels with null fields are left out.
Equal labels of a document are one example, and a doc_id of several texts is
learnt from by one of them (that with the least hash).  If the labels hold no
row, or none of a class, every score is the share of toxic labels (0 without
any).  An empty table gives an empty result.  lang, source and doc_id are no
inputs of a score, and other columns are never read by `score`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm import grams, textkit
from faktum.llm.storage import cut, table

ORDER, SHARED, PASSAGE = 4, 1.0, 16
#: Labelled rows of each class that the models are fitted on, about.
SAMPLE = 8192
FOLDS = 5
PARTS = 4
#: Tasks that count the sample, each sending its counts to the driver once.
COUNTERS = 8


@dataclass
class Model:
    table: grams.Table | None
    words: grams.Words | None
    weights: np.ndarray  # of the two differences
    offset: float

    def differences(self, texts: pa.Array) -> np.ndarray:
        """A row for each text: the greatest difference of its passages over bytes, and over words."""
        return np.column_stack([self.table.greatest(texts, PASSAGE), self.words.greatest(texts)])

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.table is None:
            return np.full(len(texts), self.offset)
        return 1 / (1 + np.exp(-np.clip(self.differences(texts) @ self.weights + self.offset, -500, 500)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of the columns of x and offset by Newton's method, with a slight ridge."""
    scale = np.maximum(np.std(x, axis=0), 1e-12)
    design = np.column_stack([x / scale, np.ones(len(x))])
    beta = np.zeros(design.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -500, 500)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * beta
        hessian = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(len(beta))
        step = np.linalg.solve(hessian, gradient)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1] / scale, float(beta[-1])


def best_cut(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the greatest weight of rows on their right side; between equals, the highest."""
    order = np.argsort(x, kind="stable")
    x, gain = x[order], np.where(y[order] == 1, -1.0, 1.0) * weight[order]
    right = np.concatenate([[0], np.cumsum(gain)])
    right[1:-1][x[1:] == x[:-1]] = -np.inf
    at = len(right) - 1 - int(np.argmax(right[::-1] >= right.max() - 1e-9))
    return float(x[0] - 1e-9 if at == 0 else x[-1] + 1e-9 if at == len(x) else (x[at - 1] + x[at]) / 2)


def held_out(doc_id, folds: int = FOLDS):
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    context = docs.sparkSession.sparkContext
    labels = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    labels = labels.filter("toxic IN (0, 1)").filter(~held_out(F.col("id"))).distinct()
    share = {x["toxic"]: x["count"] for x in labels.groupBy("toxic").count().collect()}
    total = sum(share.values())
    if len(share) < 2:
        return Model(None, None, np.zeros(2), share.get(1, 0) / total if total else 0.0)
    most = {c: min(2**63 - 1, int(min(1.0, sample / share[c]) * 2**64) - 2**63) for c in share}  # of the hashes, so about `sample` ids of a class, whatever the input
    chosen = labels.filter(F.xxhash64("id") <= F.when(F.col("toxic") == 1, most[1]).otherwise(most[0]))
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = rows.groupBy("id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = cut(rows.select("text", (F.col("toxic") + 2 * F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS))).cast("int").alias("class")))
    n = 2 * PARTS
    counted = []
    for order in (ORDER, 0):
        keys, weights = grams.gather(rows.repartition(COUNTERS).mapInArrow(textkit.tidy(grams.count_batches(n, order)), grams.PART_DDL).collect(), n)
        counted.append((keys, weights.reshape(-1, PARTS, 2)))

    def of(parts: list[int]) -> tuple[grams.Table, grams.Words]:
        sums = [(keys, by_class[:, parts].sum(axis=1)) for keys, by_class in counted]
        (g, m), (w, k) = ((keys[own.sum(axis=1) > 0], own[own.sum(axis=1) > 0]) for keys, own in sums)
        return grams.kneser_ney(g, m, ORDER, SHARED), grams.words_kneser_ney(w, k, SHARED)

    found = []
    for part in range(PARTS):  # one model at a time, as the driver's memory has to hold it
        shared = context.broadcast(Model(*of([p for p in range(PARTS) if p != part]), np.zeros(2), 0.0))
        own = rows.filter(F.floor(F.col("class") / 2) == part).mapInArrow(textkit.tidy(_differences(shared)), "over_bytes double, over_words double, y long")
        found += [tuple(x) for x in own.collect()]
        shared.destroy()
    found = np.array(found, float).reshape(-1, 3)
    x, y = found[:, :2], found[:, 2]
    if len(set(y.tolist())) < 2:
        return Model(None, None, np.zeros(2), share[1] / total)
    weight = np.where(y == 1, share[1] / max(1, (y == 1).sum()), share[0] / max(1, (y == 0).sum()))
    weight *= len(y) / weight.sum()
    slopes, _ = logistic(x, y, weight)
    return Model(*of(list(range(PARTS))), slopes, -best_cut(x @ slopes, y, weight))


def _differences(model):
    def run(batches):
        for batch in batches:
            x = model.value.differences(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1]), pa.array(np.asarray(batch.column("class").to_pylist(), np.int64) % 2)], names=["over_bytes", "over_words", "y"])

    return run


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs (doc_id, text)."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long")).alias("held_out"), "text")

    def run(batches):
        for batch in batches:
            p = model.value.score(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.mapInArrow(textkit.tidy(run), "doc_id long, held_out boolean, score double, predicted int")


def keep_ordinary(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            yield batch.filter(pa.array(model.value.score(batch.column(at)) < 0.5))

    return docs.mapInArrow(textkit.tidy(run), docs.schema)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
