"""Language identification by Bayesian evidence fusion.

Four kinds of evidence bear on a document's language l:

* its text: log P(text | l) under byte-level variable-order Markov models, one
  for each language and one background model (`und`) of single bytes, which
  wins where no language explains the text.  A byte that a language doesn't
  expect (in a name, a key or a slip) costs it at most ODD more than the
  background.  Bytes of a text depend on each other, so the sum counts as that
  of at most TEXT_BYTES bytes;
* the language its markup declares: P(declared | l);
* the suffix of its address: P(suffix | l);
* the prior of its host: P(l | host), smoothed by that of its site, which is
  smoothed by that of the whole corpus (Dirichlet, weight KAPPA).

The last three come from grouped aggregations over all documents of the
language that the text alone says.  Missing evidence (null) says nothing.
Every text is scored once; its few numbers are written down for both uses.

Every declared language is modelled that at least one in RARE of the declaring
documents declares; all rarer tags (slips and private ones among them) are one
language, `mul`, so there are RARE languages at most, whatever documents
declare.  Tags count by their primary subtag (en-us and en_GB are en).  The text
models are fitted on a bounded sample: of each language about SAMPLE documents,
the different texts with the least hashes; with more than BLOCK languages so
many fewer of each that all models together stay as large.  A language's model doesn't depend on the others, so
they are fitted and held in blocks of BLOCK.  The rest covers every document.
Evidence tables are joined whole; a host that holds a third of all rows is one
partial sum a task; tables are broadcast only after a count of their rows, and
beyond it rows with evidence are dealt out by salted keys, those without apart.

Nulls: a null or empty text is no evidence, and with none of any kind the
result is `und` with posterior 0.  Documents are kept when the best language
is a known one and has at least `least` of the posterior.  Rows that repeat
are judged alike; an empty table gives an empty result; other columns go
through `keep_known` untouched, whatever their names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.llm import grams, textkit
from faktum.llm.storage import cut, table

ORDER, TAU = 4, 2.0
#: Texts are scored in runs of about this many bytes, whose arrays are some hundred times as large.
RUN_BYTES = 1 << 18
SAMPLE, BLOCK = 2048, 64
TEXT_BYTES = 60
ODD = 2.3
KAPPA = 20.0
LEAST = 0.5
#: Tasks that count the sample, each sending its counts to the driver once.
COUNTERS = 8
UNKNOWN = "und"
#: Declared languages are told apart from this share (one in so many) on; what the others are called.
RARE, OTHER = 4096, "mul"
#: Parts that each key of a shuffled evidence table is dealt out in.
SALTS = 32
#: Tables of more rows with BLOCK languages (fewer rows with more languages) are joined by a shuffle instead of a broadcast.
BROADCAST_ROWS = 20_000


@dataclass(frozen=True)
class Evidence:
    """Columns (or nulls) of the documents that hold the evidence."""

    text: Column
    declared: Column
    host: Column
    suffix: Column


def primary(tag: Column) -> Column:
    """The primary subtag of a language tag, in lower case; private and odd tags stay whole."""
    own = F.nullif(F.lower(F.trim(tag)), F.lit(""))
    return F.when(own.rlike(r"\A[a-z]{2,8}[-_]"), F.regexp_extract(own, r"\A[a-z]+", 0)).otherwise(own)


def of_documents() -> Evidence:
    """`lang` is what a document declares and `source` its host; there is no address."""
    return Evidence(F.col("text"), primary(F.col("lang")), F.col("source"), F.lit(None).cast("string"))


def of_pages() -> Evidence:
    """The html element's lang attribute, the url's host and its last label, and the html's text without scripts, styles and tags."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[^:/?#]*://([^/?#:]*)", 1)), F.lit(""))
    declared = F.nullif(F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)), F.lit(""))
    text = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " "), r"<[^>]*>", " ")
    return Evidence(text, declared, host, F.substring_index(host, ".", -1))


def site(host: Column) -> Column:
    """The last two labels."""
    return F.substring_index(host, ".", -2)


@dataclass
class Model:
    languages: list[str]
    tables: list[grams.Table]  # of BLOCK languages each
    background: np.ndarray

    def texts(self, column: pa.Array) -> np.ndarray:
        """Log-likelihoods of each text: a column for each language, then the background's."""
        buf, offsets = grams.textkit.utf8(column)
        sizes = np.diff(offsets)
        out = np.zeros((len(sizes), len(self.languages) + 1))
        for lo, hi in grams.textkit.runs(offsets, RUN_BYTES):
            g, places = grams.byte_grams(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], ORDER)
            has = np.flatnonzero(np.diff(places))
            if len(has):
                alone = self.background[(g & grams.low(1)).astype(np.int64)]
                out[lo + has, -1] = np.add.reduceat(alone.astype(np.float64), places[has])
                for k, own in enumerate(self.tables):
                    each = np.maximum(own.of(g), (alone - ODD)[:, None])
                    out[lo + has, BLOCK * k : BLOCK * k + each.shape[1]] = np.add.reduceat(each.astype(np.float64), places[has])
        scale = np.minimum(1.0, TEXT_BYTES / np.maximum(sizes, 1))
        return out * scale[:, None]


def fit(docs: DataFrame, evidence: Evidence, sample: int = SAMPLE) -> Model | None:
    rows = docs.select(evidence.text.alias("text"), evidence.declared.alias("declared")).filter("text IS NOT NULL AND text <> ''")
    tags = cut(rows.filter(F.col("declared").isNotNull() & ~F.col("declared").isin("", UNKNOWN)).groupBy("declared").agg(F.count(F.lit(1)).alias("n")))
    total = tags.agg(F.sum("n")).first()[0] or 0
    common = F.col("n") * RARE >= total
    count = {x["declared"]: x["n"] for x in tags.filter(common).collect()}  # RARE at most
    others = tags.filter(~common).agg(F.sum("n")).first()[0]
    if others:
        count[OTHER] = count.get(OTHER, 0) + others
        rows = rows.withColumn("declared", F.when(F.col("declared").isin("", UNKNOWN) | F.col("declared").isin(*count), F.col("declared")).otherwise(F.when(F.col("declared").isNotNull(), OTHER)))
    languages = sorted(count)
    if not languages:
        return None
    sample = min(sample, max(1, sample * BLOCK // len(languages)))
    share = {x: min(1.0, sample / count[x]) for x in languages}  # of the hashes, so about `sample` texts of each language
    most = [(x, i, min(2**63 - 1, int(share[x] * 2**64) - 2**63)) for i, x in enumerate(languages)]
    chosen = rows.join(F.broadcast(docs.sparkSession.createDataFrame(most, "declared string, class int, most long")), "declared")
    chosen = chosen.filter(F.xxhash64("text") <= F.col("most")).select("text", "class").distinct()
    if len(languages) > BLOCK:
        chosen = cut(chosen)
    tables, last = [], np.full(256, 0.5)
    for lo in range(0, len(languages), BLOCK):
        n = min(BLOCK, len(languages) - lo)
        own = chosen.filter(F.col("class").between(lo, lo + n - 1)).select("text", (F.col("class") - lo).alias("class"))
        parts = own.repartition(COUNTERS).mapInArrow(textkit.tidy(grams.count_batches(n, ORDER)), grams.PART_DDL).collect()
        keys, weights = grams.gather(parts, n)
        last += np.bincount((keys & grams.low(1)).astype(np.int64), weights=weights.sum(axis=1), minlength=256)
        tables.append(grams.markov(keys, weights, ORDER, TAU))
    return Model(languages, tables, np.log(last / last.sum()))


def _with_texts(docs: DataFrame, model, schema, at: int):
    def run(batches):
        for batch in batches:
            own = model.value.texts(batch.column(at))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * own.shape[1], pa.int32()), pa.array(own.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], *batch.columns[at + 1 :], lists], names=[*[n for i, n in enumerate(batch.schema.names) if i != at], "texts"])

    return docs.mapInArrow(textkit.tidy(run), schema)


def _normal(logs: Column) -> Column:
    """Log weights to probabilities."""
    top = F.array_max(logs)
    raised = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(raised, F.lit(0.0), lambda a, x: a + x)
    return F.transform(raised, lambda x: x / total)


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + F.coalesce(y, F.lit(0.0)))


def judged(docs: DataFrame, evidence: Evidence, carried: list[Column], sample: int = SAMPLE) -> DataFrame:
    """`row` (a struct of the carried columns), language and posterior for every row of docs."""
    spark = docs.sparkSession
    row = F.struct(*carried)
    fields = [evidence.text.alias("text"), evidence.declared.alias("declared"), evidence.host.alias("host"), evidence.suffix.alias("suffix")]
    model = fit(docs, evidence, sample)
    if model is None:
        return docs.select(row.alias("row"), F.lit(UNKNOWN).alias("language"), F.lit(0.0).alias("posterior"))
    names = [*model.languages, UNKNOWN]
    size = len(names)
    shared = spark.sparkContext.broadcast(model)
    scored = cut(_with_texts(docs.select(fields[0], row.alias("row"), *fields[1:]), shared, _schema(docs, row), 0))
    shared.destroy()

    # grouped counts of what the texts alone say
    said = scored.filter(F.array_max("texts") < 0).select("declared", "host", "suffix", F.expr("array_position(texts, array_max(texts)) - 1").alias("l"))
    tallies = cut(said.groupBy("declared", "suffix", "host", "l").agg(F.count(F.lit(1)).cast("double").alias("n")))
    overall = {x["l"]: x["n"] for x in tallies.groupBy("l").agg(F.sum("n").alias("n")).collect()}
    total = sum(overall.values())
    numbers = lambda own: F.from_json(F.lit(json.dumps([float(x) for x in own])), "array<double>")
    corpus = [(overall.get(i, 0.0) + 1) / (total + size) for i in range(size)]

    def per_language(value: str) -> DataFrame:
        """For each value of a column: counts by language, and their sum."""
        own = tallies.filter(F.col(value).isNotNull()).groupBy(value, "l").agg(F.sum("n").alias("n"))
        return own.groupBy(value).agg(F.map_from_entries(F.collect_list(F.struct(F.col("l").cast("int"), "n"))).alias("by"), F.sum("n").alias("all"))

    def of(by: str, i: Column) -> Column:
        return F.coalesce(F.try_element_at(F.col(by), i), F.lit(0.0))

    def joined(rows: DataFrame, other: DataFrame, on: str) -> DataFrame:
        most = BROADCAST_ROWS * (BLOCK + 1) // max(size, BLOCK + 1)
        if other.limit(most + 1).count() <= most:
            return rows.join(F.broadcast(other), on, "left")
        known = rows.filter(F.col(on).isNotNull()).withColumn("salt", F.pmod(F.xxhash64("texts"), F.lit(SALTS)))
        dealt = other.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return known.join(dealt, [on, "salt"], "left").drop("salt").unionByName(rows.filter(F.col(on).isNull()), allowMissingColumns=True)

    def looked_up(rows: DataFrame, column: str) -> DataFrame:
        """log P(value | l), as a column `of_...`; a value that no text came with is one more value."""
        kinds = tallies.filter(F.col(column).isNotNull()).select(column).distinct().count() + 1
        seen = {x["l"]: x["n"] for x in tallies.filter(F.col(column).isNotNull()).groupBy("l").agg(F.sum("n").alias("n")).collect()}
        totals = [seen.get(i, 0.0) + 0.5 * kinds for i in range(size)]
        table = per_language(column).select(column, F.transform(numbers(totals), lambda x, i: F.log((of("by", i) + 0.5) / x)).alias(f"of_{column}"))
        rows = joined(rows, cut(table), column)
        unseen = numbers(np.log(0.5 / np.array(totals)))
        return rows.withColumn(f"of_{column}", F.when(F.col(column).isNotNull(), F.coalesce(f"of_{column}", unseen)).otherwise(numbers([0.0] * size)))

    hosts = per_language("host").withColumn("site", site(F.col("host")))
    sites = tallies.filter("host IS NOT NULL").groupBy(site(F.col("host")).alias("site"), "l").agg(F.sum("n").alias("n"))
    sites = sites.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l").cast("int"), "n"))).alias("site_by"), F.sum("n").alias("site_all"))
    hosts = hosts.join(sites, "site")
    prior = F.transform(numbers(corpus), lambda c, i: F.log((of("by", i) + KAPPA * (of("site_by", i) + KAPPA * c) / (F.col("site_all") + KAPPA)) / (F.col("all") + KAPPA)))
    hosts = cut(hosts.select("host", prior.alias("prior")))

    scored = joined(scored, hosts, "host")
    scored = looked_up(looked_up(scored, "declared"), "suffix")
    prior = F.coalesce("prior", numbers(np.log(corpus)))
    logs = _plus(_plus(_plus(F.col("texts"), prior), F.col("of_declared")), F.col("of_suffix"))
    scored = scored.withColumn("p", _normal(logs))
    nothing = (F.array_max("texts") == 0) & F.col("declared").isNull() & F.col("suffix").isNull() & F.col("host").isNull()
    best = F.element_at(F.array(*map(F.lit, names)), F.expr("cast(array_position(p, array_max(p)) as int)"))
    return scored.select("row", F.when(nothing, UNKNOWN).otherwise(best).alias("language"), F.when(nothing, 0.0).otherwise(F.array_max("p")).alias("posterior"))


def _schema(docs: DataFrame, row: Column):
    from pyspark.sql import types as T

    fields = [T.StructField("row", docs.select(row.alias("row")).schema["row"].dataType)]
    fields += [T.StructField(x, T.StringType()) for x in ("declared", "host", "suffix")]
    return T.StructType([*fields, T.StructField("texts", T.ArrayType(T.DoubleType()))])


def kept(language: Column, posterior: Column, least: float = LEAST) -> Column:
    return (language != UNKNOWN) & (posterior >= least)


def keep_known(docs: DataFrame, evidence: Evidence | None = None, least: float = LEAST) -> DataFrame:
    """The rows of docs whose language is known, with all their columns."""
    out = judged(docs, evidence or of_documents(), [F.col(f"`{c}`") for c in docs.columns])
    return out.filter(kept(F.col("language"), F.col("posterior"), least)).select("row.*")


def pages_language_id(spark, sf_dir: str) -> DataFrame:
    """The same over pages, where all four kinds of evidence act."""
    out = judged(table(spark, sf_dir, "pages"), of_pages(), [F.col("page_id")])
    return out.select("row.page_id", "language", F.round("posterior", 6).alias("posterior"), kept(F.col("language"), F.col("posterior")).alias("kept"))


def op3_language_id(spark, sf_dir: str) -> DataFrame:
    out = judged(table(spark, sf_dir, "documents"), of_documents(), [F.col("doc_id")])
    return out.select("row.doc_id", "language", F.round("posterior", 6).alias("posterior"), kept(F.col("language"), F.col("posterior")).alias("kept"))
