"""Language-model scoring by context-tree weighting.

Statistics are gathered by messages, never broadcast with the corpus: texts
lie in blocks of bounded size; a block sends its distinct grams and words with
their training counts to the buckets that own them; a bucket adds up all
blocks' counts, weights its part of the trees, and answers each block with the
values of what that block asked for.  Buckets are bounded in number, as
distinct grams grow ever slower than the texts, so messages grow with the
input.  Beyond REGION blocks, a bucket's messages are added up region by
region, the regions' sums as a tree of FAN branches, and each region answers
its own blocks from the totals.  Only the nodes of depths 0 and 1 (at
most 65,280, whatever the input) pass through the driver.

Nulls: a null text is empty, a null id belongs to training.  An empty text
has the end mark alone.  Repeated rows count as often as they occur, and each
gets its score.  An empty table gives an empty result.  Other columns are not
read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm import context_tree as tree
from faktum.llm import textkit
from faktum.llm.storage import cut, table

DEPTH = 5
BLOCK_BYTES = 24 << 20
RUN_BYTES = 2 << 20
#: Buckets, at most; blocks whose messages to a bucket one task holds; sums that one task adds up.
BUCKETS, REGION, FAN = 4096, 256, 32
GRAM, WORD = 0, 1
#: Stands among the word hashes for the end of a text.
END_WORD = np.uint64(0)


def held_out(doc_id, folds: int):
    """True for the fold with remainder 0; null ids are in training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(False))


class _Lookup:
    """Places of values in an ascending array of distinct keys that holds them all."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 4))))
        self.shift = np.uint64(64 - bits)
        self.slots = np.zeros(1 << bits, np.int32)
        self.slots[self._slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self.slots[self._slot(keys)]
        wrong = np.flatnonzero(self.keys[at] != keys)
        at[wrong] = np.searchsorted(self.keys, keys[wrong])
        return at


def _runs(buf: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi in textkit.runs(offsets, RUN_BYTES):
        yield lo, hi, textkit.fold(buf[offsets[lo] : offsets[hi]]), offsets[lo : hi + 1] - offsets[lo]


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tree.tally(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def _counted(keys: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their counts outside the held-out rows (0 for those seen only there)."""
    out = []
    for part, weight in ((keys[~held], 1), (keys[held], 0)):
        part = np.sort(part)
        if len(part):
            first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            out.append((part[first], np.diff(np.append(first, len(part))) * weight))
    return _merge(out)


def _distinct(texts: pa.ChunkedArray, held: np.ndarray, depth: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    buf, offsets = textkit.utf8(texts)
    grams, words = [], []
    for lo, hi, own, at in _runs(buf, offsets):
        g, places = tree.grams(own, at, depth)
        grams.append(_counted(g, np.repeat(held[lo:hi], np.diff(places))))
        h, owner, _ = textkit.words(own, at)
        words.append(_counted(h, held[lo:hi][owner]))
        if len(grams) == 8:
            grams, words = [_merge(grams)], [_merge(words)]
    words.append((np.array([END_WORD]), np.array([int((~held).sum())])))
    return _merge(grams), _merge(words)


def _bucket(kind: int, keys: np.ndarray, buckets: int, depth: int) -> np.ndarray:
    """Grams that share their two latest context bytes stay together."""
    owner = keys >> np.uint64(8 * (depth - 1)) if kind == GRAM else keys
    return (textkit.mix64(owner + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)


def _held(column: pa.ChunkedArray) -> np.ndarray:
    return np.asarray(column.to_pylist(), dtype=bool)


def _message(depth: int, buckets: int):
    def send(rows: pa.Table) -> pa.Table:
        held = _held(rows["held_out"])
        block = rows["block"][0].as_py() if len(rows) else 0
        out = []
        for kind, (keys, counts) in enumerate(_distinct(rows["text"], held, depth)):
            owner = _bucket(kind, keys, buckets, depth)
            order = np.argsort(owner, kind="stable")
            bounds = np.searchsorted(owner[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(bounds)):
                at = order[bounds[b] : bounds[b + 1]]
                out.append((block, int(b), kind, keys[at].tobytes(), counts[at].astype("<u4").tobytes()))
        return pa.Table.from_pylist([dict(zip(MESSAGE.names, x, strict=True)) for x in out], schema=MESSAGE)

    return send


MESSAGE = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])
GATHERED = pa.schema(
    [("bucket", pa.int32()), ("region", pa.int64()), ("keys", pa.list_(pa.binary())), ("counts", pa.list_(pa.binary())), ("blocks", pa.list_(pa.int64())), ("kinds", pa.list_(pa.int32())), ("places", pa.list_(pa.binary()))]
    + [("node", pa.list_(pa.int64())), *((x, pa.list_(pa.float64())) for x in ("a", "b", "children"))]
)
ANSWER = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("values", pa.binary())])


def _gather(depth: int):
    """One row for a bucket: its keys and total counts by kind, what each block asked for as places among the keys, and what the nodes of depth 1 sum over it (words: at node -1, their total count and the number of those with a count)."""

    def add(rows: pa.Table) -> pa.Table:
        asked = [(x["block"], x["kind"], np.frombuffer(x["keys"], np.uint64), np.frombuffer(x["counts"], "<u4")) for x in rows.select(["block", "kind", "keys", "counts"]).to_pylist()]
        if not asked:
            return GATHERED.empty_table()
        all_ = [_merge([(k, c.astype(np.int64)) for _, own, k, c in asked if own == kind]) for kind in (GRAM, WORD)]
        row = _totals(rows, all_, depth) | {
            "blocks": [x[0] for x in asked],
            "kinds": [x[1] for x in asked],
            "places": [np.searchsorted(all_[x[1]][0], x[2]).astype("<u4").tobytes() for x in asked],
        }
        return pa.Table.from_pylist([row], schema=GATHERED)

    return add


def _totals(rows: pa.Table, all_: list[tuple[np.ndarray, np.ndarray]], depth: int) -> dict:
    node, a, b, children = _sums(*all_[GRAM], depth)
    words = all_[WORD][1]
    return {
        "bucket": rows["bucket"][0].as_py(),
        "region": rows["region"][0].as_py(),
        "keys": [x[0].tobytes() for x in all_],
        "counts": [x[1].astype("<i8").tobytes() for x in all_],
        "node": [-1, *node.tolist()],
        "a": [float(words.sum()), *a.tolist()],
        "b": [float((words > 0).sum()), *b.tolist()],
        "children": [0.0, *children.tolist()],
    }


def _added(depth: int):
    """One row for a bucket's sums of several regions."""

    def add(rows: pa.Table) -> pa.Table:
        if not len(rows):
            return GATHERED.empty_table()
        parts = rows.select(["keys", "counts"]).to_pylist()
        all_ = [_merge([(np.frombuffer(x["keys"][kind], np.uint64), np.frombuffer(x["counts"][kind], "<i8")) for x in parts]) for kind in (GRAM, WORD)]
        return pa.Table.from_pylist([dict.fromkeys(GATHERED.names) | _totals(rows, all_, depth)], schema=GATHERED)

    return add


def _sums(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    seen = counts > 0
    own = tree.Tree(keys[seen], counts[seen], depth, 2)
    above, at = np.unique(tree.shorter(own.nodes[2]), return_inverse=True)
    return above.astype(np.int64), *(np.bincount(at, weights=x, minlength=len(above)) for x in (own.zeros[2], own.ones[2], own.log_pw[2]))


def _valued(row: dict, depth: int, shared) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A bucket's keys and their values, by kind."""
    above, acc, rest = shared.value
    keys, counts = ([np.frombuffer(x, kind) for x in row[name]] for name, kind in (("keys", np.uint64), ("counts", "<i8")))
    seen = counts[GRAM] > 0
    own = tree.Tree(keys[GRAM][seen], counts[GRAM][seen], depth, 2)
    up = tree.shorter(own.nodes[2]).astype(np.int64)
    own.spread(acc[up], rest[up])
    return keys, [own.log2(keys[GRAM], above).astype("<f4"), counts[WORD]]


def _values(depth: int, shared):
    def give(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {x: batch.column(x)[i].as_py() for x in ("bucket", "keys", "counts")}
                keys, values = _valued(row, depth, shared)
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]], pa.int32()), *(pa.array([[x.tobytes() for x in own]], pa.list_(pa.binary())) for own in (keys, values))], names=["bucket", "all_keys", "all_values"])

    return give


def _answers(depth: int, shared):
    """Replies to the blocks of each row; the values are its own, or (without `shared`) come with the bucket's total."""

    def reply(batches):
        for batch in batches:
            for i in range(len(batch)):
                row = {x: batch.column(x)[i].as_py() for x in batch.schema.names}
                if shared is not None:
                    values = _valued(row, depth, shared)[1]
                else:
                    every = [np.frombuffer(x, np.uint64) for x in row["all_keys"]]
                    values = [np.frombuffer(x, "<f4" if kind == GRAM else "<i8") for kind, x in enumerate(row["all_values"])]
                    values = [v[np.searchsorted(k, np.frombuffer(own, np.uint64))] for k, v, own in zip(every, values, row["keys"], strict=True)]
                out = [values[kind][np.frombuffer(places, "<u4")].tobytes() for kind, places in zip(row["kinds"], row["places"], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(row["blocks"], pa.int64()), pa.array([row["bucket"]] * len(out), pa.int32()), pa.array(row["kinds"], pa.int32()), pa.array(out, pa.binary())], schema=ANSWER)

    return reply


RESULT = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())]
)


def _placed(keys: np.ndarray, kind: int, buckets: int, depth: int, answers: dict[tuple[int, int], np.ndarray]) -> np.ndarray:
    """The buckets' answers in the order of the keys."""
    owner = _bucket(kind, keys, buckets, depth)
    order = np.argsort(owner, kind="stable")
    out = np.zeros(len(keys), np.float64 if kind == GRAM else np.int64)
    if len(keys):
        out[order] = np.concatenate([answers[kind, int(b)] for b in np.unique(owner)])
    return out


def _scores(depth: int, buckets: int, total: int, kinds: int):
    scale = math.log10(total + 0.1 * (kinds + 1))

    def score(rows: pa.Table, replies: pa.Table) -> pa.Table:
        n = len(rows)
        if not n:
            return RESULT.empty_table()
        held = _held(rows["held_out"])
        answers = {(x["kind"], x["bucket"]): np.frombuffer(x["values"], "<f4" if x["kind"] == GRAM else "<i8") for x in replies.to_pylist()}
        (grams, _), (words, _) = _distinct(rows["text"], held, depth)
        log2 = _placed(grams, GRAM, buckets, depth, answers)
        count = _placed(words, WORD, buckets, depth, answers)
        log_word = np.log10(count + 0.1) - scale
        gram_at, word_at = _Lookup(grams), _Lookup(words)
        end = int(word_at(np.array([END_WORD]))[0])
        tokens, known = np.ones(n, np.int64), np.full(n, int(count[end] > 0), np.int64)
        base, bits = np.full(n, log_word[end]), np.zeros(n)
        buf, offsets = textkit.utf8(rows["text"])
        for lo, hi, own, at in _runs(buf, offsets):
            g, places = tree.grams(own, at, depth)
            bits[lo:hi] = np.add.reduceat(log2[gram_at(g)], places[:-1])
            h, owner, _ = textkit.words(own, at)
            place = word_at(h)
            tokens[lo:hi] += np.bincount(owner, minlength=hi - lo)
            known[lo:hi] += np.bincount(owner, weights=count[place] > 0, minlength=hi - lo).astype(np.int64)
            base[lo:hi] += np.bincount(owner, weights=log_word[place], minlength=hi - lo)
        return pa.table(
            [rows["doc_id"].combine_chunks(), pa.array(held), pa.array(tokens), pa.array(known), pa.array(np.full(n, total)), pa.array(base), pa.array(bits * math.log10(2)), pa.array(-bits / (np.diff(offsets) + 1))],
            schema=RESULT,
        )

    return score


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.bool_(): "boolean", pa.binary(): "binary"}
    kinds |= {pa.list_(k): f"array<{v}>" for k, v in kinds.items()}
    return ", ".join(f"{x.name} {kinds[x.type]}" for x in schema)


def score_documents(docs: DataFrame, depth: int = DEPTH, folds: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores every whole text with a context-tree model of depth `depth` trained on all but the held-out fold.

    docs: doc_id long, text string.  Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score (word
    unigrams), score (log10 of the tree's probability of the lower-cased text and its end) and bits_per_byte (the same
    as a code length).  block_bytes bounds the text that one task holds, but for a single longer text.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2, -(-size // block_bytes))
    docs = docs.withColumn("held_out", held_out(F.col("doc_id"), folds)).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    buckets, regions = min(blocks, BUCKETS), -(-blocks // REGION)
    messages = docs.groupBy("block").applyInArrow(_message(depth, buckets), _ddl(MESSAGE))
    messages = messages.withColumn("region", F.floor(F.col("block") / REGION))
    gathered = totals = cut(messages.groupBy("bucket", "region").applyInArrow(_gather(depth), _ddl(GATHERED)))
    left = regions
    while left > 1:
        part = totals.select("bucket", F.floor(F.col("region") / FAN).alias("region"), "keys", "counts")
        totals, left = cut(part.groupBy("bucket", "region").applyInArrow(_added(depth), _ddl(GATHERED))), -(-left // FAN)
    sums = totals.select(F.inline(F.arrays_zip("node", "a", "b", "children")))
    sums = sums.groupBy("node").agg(*(F.sum(x).alias(x) for x in ("a", "b", "children"))).toPandas()
    words = sums[sums["node"] < 0]
    total, kinds = (int(words["a"].iloc[0]), int(words["b"].iloc[0])) if len(words) else (0, 0)
    nodes = sums[sums["node"] >= 0]
    shared = spark.sparkContext.broadcast(tree.top(*(nodes[x].to_numpy() for x in ("node", "a", "b", "children"))))
    asked = ["bucket", "keys", "blocks", "kinds", "places"]
    if regions == 1:
        replies = gathered.select(*asked, "counts").mapInArrow(textkit.tidy(_answers(depth, shared)), _ddl(ANSWER))
    else:
        values = totals.select("bucket", "keys", "counts").mapInArrow(textkit.tidy(_values(depth, shared)), "bucket int, all_keys array<binary>, all_values array<binary>")
        replies = gathered.select(*asked).join(values, "bucket").mapInArrow(textkit.tidy(_answers(depth, None)), _ddl(ANSWER))
    return docs.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_scores(depth, buckets, total, kinds), _ddl(RESULT))


def op6_lm_scoring(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
