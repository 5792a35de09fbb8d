"""Near-duplicate groups by b-bit MinHash.

Words are runs of bytes other than white space, A-Z lower-cased; a document's
set holds its distinct word shingles.  Documents are linked when
100 * intersection >= 80 * union, and grouped by reachability.

1. One pass over the texts gives each document its set's size and 128-bit
   hash, 352 minima, 50 band keys of 7 minima each, and the low 2 bits of every
   minimum packed into 11 longs.  A pair at the threshold misses all bands with
   a probability below 1e-5, one at 0.85 below 1e-8.
2. Documents with the same set are one node from here on.
3. Nodes that share a band bucket are candidates.  Equal low bits, counted on
   the packed signatures and corrected for chance agreement, estimate their
   similarity.  A bucket's members are compared inside one task, which gives
   out a spanning forest of what is not more than six standard errors below
   the threshold, never its pairs.  What these edges connect is a cluster.
4. The members of a cluster are compared on their full sets where their sizes
   and their estimate allow a link; again a task gives out a spanning forest of
   the links.  Their components are the groups.

A large bucket or cluster is dealt out in blocks.  First each block is compared
in itself and with the least member of all.  Then a bucket's members that lie
outside the largest component go to every block.  A cluster is parted before
that, as clusters of what looks alike can be wide and hold few links: sets at
the threshold share one of their first shingles in any order (prefix filtering),
so members meet by these, the rarer shingles first, and only those that a shared
one, their sizes and its places allow to be linked stay together.  No bucket,
cluster or number of partners is capped, and every pair that shares a bucket is
compared, already connected, or can't be linked.

Nulls: a null text counts as empty.  A document without words is linked with
nothing.  A row with a null doc_id takes no part: its component is null and it
is kept.  Rows that repeat a doc_id belong to one document, which links all
that any of its texts links.  An empty table gives an empty result; other
columns are never read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.llm import textkit
from faktum.llm.components import components
from faktum.llm.storage import cut, table

BITS = 2
HASHES, BANDS, ROWS = 352, 50, 7
LONGS = HASHES * BITS // 64
_CHANCE = 2.0**-BITS
_LANES = np.uint64(sum(1 << i for i in range(0, 64, BITS)))
#: Members of a bucket, and shingles of a cluster, that one block holds at most (but for a longer text).
BUCKET_BLOCK, CLUSTER_BLOCK = 4096, 1 << 20
_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)
_STEP = 128

SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64())), ("signature", pa.list_(pa.int64()))])
SIGNED_DDL = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, signature array<long>"


def minima(values: np.ndarray, work: np.ndarray) -> np.ndarray:
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    short = (values >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(short), _STEP):
        part = short[i : i + _STEP]
        own = work[: len(part)]
        np.multiply(part[:, None], _MULTIPLY[None, :], out=own)
        own += _ADD
        np.minimum(out, own.min(axis=0), out=out)
    return out


def pack(least: np.ndarray) -> np.ndarray:
    """The low bits of each row's (remixed) minima, packed into longs."""
    low = textkit.mix64(least.astype(np.uint64)) & np.uint64((1 << BITS) - 1)
    lanes = low.reshape(len(least), LONGS, 64 // BITS) << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))
    return np.bitwise_or.reduce(lanes, axis=2).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least[:, : BANDS * ROWS].reshape(len(least), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(ROWS):
        key = textkit.mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key.view(np.int64)


def _sign(width: int):
    def sign(batches):
        work = np.empty((_STEP, HASHES), np.uint32)
        for batch in batches:
            ids = batch.column("doc_id")
            buf, offsets = textkit.utf8(batch.column("text"))
            for lo, hi in textkit.runs(offsets):
                value, places = _sets(buf, offsets, lo, hi, width)
                sizes = np.diff(places)
                has = np.flatnonzero(sizes)
                least = np.array([minima(value[places[i] : places[i + 1]], work) for i in has], np.uint32).reshape(len(has), HASHES)
                yield pa.RecordBatch.from_arrays([ids[lo:hi], pa.array(sizes), *_hashes(value, places), _lists(band_keys(least), has, hi - lo), _lists(pack(least), has, hi - lo)], schema=SIGNED)

    return sign


def _sets(buf: np.ndarray, offsets: np.ndarray, lo: int, hi: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    return textkit.shingles(*textkit.words(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), width)


def _hashes(value: np.ndarray, places: np.ndarray) -> list[pa.Array]:
    """The two halves of each set's hash."""
    has, out = np.flatnonzero(np.diff(places)), []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.zeros(len(places) - 1, np.uint64)
        if len(has):
            sums[has] = np.add.reduceat(textkit.mix64(value ^ np.uint64(salt)), places[has])
        out.append(pa.array(sums.view(np.int64)))
    return out


def _lists(values: np.ndarray, rows: np.ndarray, n: int) -> pa.Array:
    """A list for each of n rows: one of `values` for `rows`, an empty one for others."""
    sizes = np.zeros(n + 1, np.int32)
    sizes[rows + 1] = values.shape[1] if len(rows) else 0
    return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(values.ravel()))


def _sets_of(width: int):
    def give(batches):
        for batch in batches:
            ids = batch.column("rep")
            buf, offsets = textkit.utf8(batch.column("text"))
            for lo, hi in textkit.runs(offsets):
                value, places = _sets(buf, offsets, lo, hi, width)
                lists = pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids[lo:hi], *_hashes(value, places), lists], names=["rep", "set_a", "set_b", "members"])

    return give


def similarity(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The estimate from packed signatures: the share of equal lanes, corrected for those equal by chance."""
    unequal = one ^ many
    unequal = np.bitwise_count((unequal | (unequal >> np.uint64(1))) & _LANES).sum(axis=1)
    return (1 - unequal / HASHES - _CHANCE) / (1 - _CHANCE)


def least_estimate(percent: int) -> float:
    """Six standard errors below the threshold."""
    p = percent / 100 + (1 - percent / 100) * _CHANCE
    return percent / 100 - 6 * (p * (1 - p) / HASHES) ** 0.5 / (1 - _CHANCE)


def _whole_groups(batches) -> Iterator[pa.Table]:
    """The rows of sorted batches again, none of whose (key, block) is split over two tables."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        key, block = (batch.column(c).to_numpy() for c in ("key", "block"))
        same = (key == key[-1]) & (block == block[-1])
        at = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if held and (at or last != (key[-1], block[-1])):
            yield pa.Table.from_batches([*held, batch.slice(0, at)])
            held = []
        elif at:
            yield pa.Table.from_batches([batch.slice(0, at)])
        held.append(batch.slice(at))
        last = (key[-1], block[-1])
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column as uint64, and n + 1 places."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def _forest(label: np.ndarray, sources: np.ndarray, targets: np.ndarray | None, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links between rows of different labels, one for each two labels that they join; changes the labels.

    Sources are held against the targets, or (None) against the rows after them.
    """
    out = []
    for s in sources.tolist():
        rest = np.flatnonzero(label[s + 1 :] != label[s]) + s + 1 if targets is None else targets[label[targets] != label[s]]
        if len(rest) and len(hit := rest[near(s, rest)]):
            joined, at = np.unique(label[hit], return_index=True)
            label[np.isin(label, joined)] = label[s]
            out += [(s, h) for h in hit[at].tolist()]
    return out


class _Sets:
    """Counts what one set of a block has in common with others."""

    def __init__(self, flat: np.ndarray, places: np.ndarray):
        kinds, code = np.unique(flat, return_inverse=True)
        self.code, self.places, self.mark = code, places, np.zeros(len(kinds), bool)

    def common(self, s: int, rest: np.ndarray) -> np.ndarray:
        own = self.code[self.places[s] : self.places[s + 1]]
        self.mark[own] = True
        if 4 * len(rest) > len(self.places):
            sums = np.concatenate([[0], np.cumsum(self.mark[self.code])])
            out = sums[self.places[rest + 1]] - sums[self.places[rest]]
        else:
            out = np.array([np.count_nonzero(self.mark[self.code[self.places[r] : self.places[r + 1]]]) for r in rest.tolist()])
        self.mark[own] = False
        return out


def _compared(percent: int, exact: bool):
    """For mapInArrow over (key, block, rep, signature, n_shingles or members, and own, home, far where blocks meet the rest): links (u, v)."""
    floor = least_estimate(percent)

    def run(batches):
        for rows in _whole_groups(batches):
            key, block, rep = (rows[c].to_numpy() for c in ("key", "block", "rep"))
            signature = _flat(rows["signature"])[0].reshape(-1, LONGS)
            flat, places = _flat(rows["members"]) if exact else (None, None)
            size = np.diff(places) if exact else rows["n_shingles"].to_numpy()
            own, home, far = (rows[c].to_numpy(zero_copy_only=False) for c in ("own", "home", "far")) if "own" in rows.column_names else (None, None, None)
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            bounds = np.append(first, len(key))

            def similar(a, b):
                alike = percent * np.maximum(size[a], size[b]) <= 100 * np.minimum(size[a], size[b])
                return alike & (similarity(signature[a], signature[b]) >= floor)

            u, v = [], []
            with_first = None
            if own is None and not exact:  # the first member of each bucket with all others, at once
                lead = np.repeat(first, np.diff(bounds))
                with_first = similar(lead, np.arange(len(key)))
                at = np.flatnonzero(with_first & (lead != np.arange(len(key))))
                u.append(lead[at])
                v.append(at)
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                if hi - lo < 2 or (with_first is not None and (hi - lo == 2 or with_first[lo:hi].all())):
                    continue
                sets = _Sets(flat[places[lo] : places[hi]], places[lo : hi + 1] - places[lo]) if exact else None

                def near(s, rest, lo=lo, sets=sets):
                    ok = similar(lo + s, lo + rest)
                    if sets is not None and ok.any():
                        left = rest[ok]
                        both = sets.common(s, left)
                        ok[ok] = 100 * both >= percent * (size[lo + s] + size[lo + left] - both)
                    return ok

                if own is None:
                    label = np.arange(hi - lo)
                    if with_first is not None:
                        label[with_first[lo:hi]] = 0
                    sources, targets = np.arange(hi - lo) if with_first is None else np.arange(1, hi - lo), None
                else:
                    label = np.unique(own[lo:hi], return_inverse=True)[1]
                    sources, targets = np.flatnonzero(far[lo:hi]), np.flatnonzero(home[lo:hi])
                links = np.array(_forest(label, sources, targets, near), np.int64).reshape(-1, 2) + lo
                u.append(links[:, 0])
                v.append(links[:, 1])
            u, v = (rep[np.concatenate(x)] if x else rep[:0] for x in (u, v))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return run


#: Counters of shingles, by which a cluster's rarer ones go first; several shingles may share one.
COUNTERS = 1 << 18


def _counted(batches) -> Iterator[pa.RecordBatch]:
    """How often the shingles of each counter stand in the rows of a task."""
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        flat, _ = _flat(pa.chunked_array([batch.column("members")]))
        total += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
    slot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(total[slot])], names=["slot", "n"])


def prefix_lengths(n: int, percent: int) -> tuple[int, int]:
    """Of a set of n, how many first shingles it shares one with any larger set at the threshold, and with any smaller one."""
    return n + 1 - -(-2 * percent * n // (100 + percent)), n + 1 - -(-percent * n // 100)


def _prefixes(percent: int, counts: np.ndarray):
    def run(batches):
        for batch in batches:
            key, rep = (batch.column(c).to_numpy().view(np.uint64) for c in ("key", "rep"))
            flat, places = _flat(pa.chunked_array([batch.column("members")]))
            token, size, place, first, of = [], [], [], [], []
            for i in range(len(rep)):
                own = flat[places[i] : places[i + 1]]
                small, large = prefix_lengths(len(own), percent)
                order = np.lexsort((own, counts[(own % np.uint64(COUNTERS)).astype(np.int64)]))[:large]
                token.append(textkit.mix64(own[order] ^ textkit.mix64(key[i : i + 1])))
                size.append(np.full(len(order), len(own)))
                place.append(np.arange(len(order)))
                first.append(np.arange(len(order)) < small)
                of.append(np.full(len(order), rep[i]))
            if of:
                columns = [np.concatenate(x) for x in (token, of, size, place, first)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0].view(np.int64)), pa.array(columns[1].view(np.int64)), *(pa.array(c) for c in columns[2:])], names=["key", "rep", "n", "place", "first"])

    return run


def _allowed(percent: int):
    """For mapInArrow over (key, block, rep, n, place, first, own, travels, home): links (u, v) between different labels that a shared shingle allows."""

    def run(batches):
        for rows in _whole_groups(batches):
            key, block, rep, n, place, own = (rows[c].to_numpy() for c in ("key", "block", "rep", "n", "place", "own"))
            first, travels, home = (rows[c].to_numpy(zero_copy_only=False) for c in ("first", "travels", "home"))
            starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])]))
            u, v = [rep[:0]], [rep[:0]]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True):
                if hi - lo < 2 or (own[lo:hi] == own[lo]).all():
                    continue

                def near(s, rest, lo=lo):
                    a, b = lo + s, lo + rest
                    alike = percent * np.maximum(n[a], n[b]) <= 100 * np.minimum(n[a], n[b])
                    common = np.minimum(n[a] - place[a], n[b] - place[b])  # at most, if this is the first one that they share
                    return alike & (first[a] | first[b]) & ((100 + percent) * common >= percent * (n[a] + n[b]))

                label = np.unique(own[lo:hi], return_inverse=True)[1]
                links = np.array(_forest(label, np.flatnonzero(travels[lo:hi]), np.flatnonzero(home[lo:hi]), near), np.int64).reshape(-1, 2) + lo
                u.append(rep[links[:, 0]])
                v.append(rep[links[:, 1]])
            u, v = np.concatenate(u), np.concatenate(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(u, v)), pa.array(np.minimum(u, v))], names=["u", "v"])

    return run


def _linkable(rows: DataFrame, labels: DataFrame, percent: int, n: int) -> DataFrame:
    """Links (u, v) between members of one key and different labels that prefix filtering leaves, as forests.

    labels: (rep, own, far).  Two members with different labels are never both of the main one.  A row travels to all
    blocks of its shingle if it is far and one of the first ones of its set; and for what is left, far rows against first
    ones of the main label, either those far rows or these first ones travel, whichever are fewer.
    """
    counts = np.zeros(COUNTERS, np.int64)
    for r in rows.select("members").mapInArrow(textkit.tidy(_counted), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        counts[r["slot"]] = r["n"]
    tokens = rows.select("key", "rep", "members").mapInArrow(textkit.tidy(_prefixes(percent, counts)), "key long, rep long, n long, place long, first boolean")
    tokens = cut(tokens.join(labels, "rep"))
    sums = tokens.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.count_if("far").alias("fars"), F.count_if(~F.col("far") & F.col("first")).alias("mains"))
    tokens = tokens.join(sums.filter("weight > 1 AND fars > 0"), "key").withColumn("blocks", F.ceil(F.col("weight") / BUCKET_BLOCK))
    moves = F.when(F.col("far") & F.col("first"), True).when(F.col("far"), F.col("fars") <= F.col("mains")).otherwise(F.col("first") & (F.col("fars") > F.col("mains")))
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    dealt = tokens.withColumn("travels", moves).withColumn("block", F.explode(F.when(F.col("travels"), every).otherwise(F.array(own)))).withColumn("home", F.col("block") == own)
    dealt = dealt.select("key", "block", "rep", "n", "place", "first", "own", "travels", "home")
    return dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "rep").mapInArrow(textkit.tidy(_allowed(percent)), "u long, v long").filter("u <> v").distinct()


def _labelled(found: DataFrame, rows: DataFrame, column: str, label: str) -> DataFrame:
    own = found.select(F.col("node").alias(column), F.col("component").alias(label))
    return rows.join(own, column, "left").withColumn(label, F.coalesce(label, column))


def _connected(rows: DataFrame, percent: int, exact: bool, most: int, more: DataFrame | None = None) -> DataFrame:
    """Components of the links inside each key of rows (key, rep, least, weight of the whole key, blocks, signature, n_shingles or members) and of more links.

    A block of the second round weighs at most about `most`.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["key", "block", "rep", "signature", "members" if exact else "n_shingles"]

    def links(dealt: DataFrame) -> DataFrame:
        return dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "rep").mapInArrow(textkit.tidy(_compared(percent, exact)), "u long, v long").filter("u <> v").distinct()

    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    first = links(rows.withColumn("block", F.explode(F.when(F.col("rep") == F.col("least"), every).otherwise(F.array(own)))).select(*columns))
    found = components(first if more is None else first.unionByName(more))
    wide = rows.filter("blocks > 1")
    if wide.isEmpty():
        return found
    if exact:
        return _connected_wide(wide, found, percent, most, links, n)
    wide = _labelled(found, wide, "rep", "own")
    by = wide.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "own"))["own"].alias("main"), F.count(F.lit(1)).alias("kinds"))
    wide = wide.join(by.filter("kinds > 1").select("key", "main"), "key")
    wide = wide.withColumn("blocks", F.greatest(F.ceil(F.col("weight") / most), F.ceil(F.sqrt("blocks")))).withColumn("far", F.col("own") != F.col("main"))
    wide = wide.withColumn("block", F.explode(F.when(F.col("far"), every).otherwise(F.array(own)))).withColumn("home", F.col("block") == own)
    second = cut(links(wide.select(*columns, "own", "home", "far")))
    if second.isEmpty():
        return found
    return components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(second))


def _mains(labels: DataFrame) -> DataFrame:
    """labels (key, rep, own) of the keys with several labels, with far: outside the commonest one."""
    by = labels.groupBy("key", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "own"))["own"].alias("main"), F.count(F.lit(1)).alias("kinds"))
    return labels.join(by.filter("kinds > 1").select("key", "main"), "key").withColumn("far", F.col("own") != F.col("main")).drop("main")


def _connected_wide(wide: DataFrame, found: DataFrame, percent: int, most: int, links: Callable[[DataFrame], DataFrame], n: int) -> DataFrame:
    """Components of the links in clusters of several blocks, whose blocks have been compared in themselves.

    Full sets move once more only with the members of what prefix filtering leaves together and isn't connected yet.
    """
    labels = cut(_mains(_labelled(found, wide.select("key", "rep").distinct(), "rep", "own")))
    if labels.isEmpty():
        return found
    several = wide.join(labels.select("key").distinct(), "key", "left_semi")
    together = _joined(_linkable(several, labels.drop("key"), percent, n), labels)
    if together.isEmpty():
        return found
    parts = _mains(_labelled(together, labels.select("rep", "own"), "own", "key"))
    sizes = wide.groupBy("rep").agg(F.sum(F.size("members")).alias("size"), F.max("blocks").alias("before"))
    parts = cut(parts.join(sizes, "rep"))
    weights = parts.groupBy("key").agg(F.sum("size").alias("weight"), F.max("before").alias("before"))
    parts = parts.drop("before").join(weights, "key").withColumn("blocks", F.greatest(F.ceil(F.col("weight") / most), F.ceil(F.sqrt("before"))))
    rows = wide.select("rep", "signature", "members").join(parts.select("key", "rep", "own", "far", "blocks"), "rep")
    own = F.pmod(F.xxhash64("rep"), F.col("blocks"))
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    rows = rows.withColumn("block", F.explode(F.when(F.col("far"), every).otherwise(F.array(own)))).withColumn("home", F.col("block") == own)
    second = cut(links(rows.select("key", "block", "rep", "signature", "members", "own", "home", "far")))
    if second.isEmpty():
        return found
    joined = _joined(second, labels)
    more = joined.select(F.col("node").alias("component"), F.col("component").alias("_to"))
    return found.join(more, "component", "left").select("node", F.coalesce("_to", "component").alias("component")).unionByName(joined)


def _joined(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Components of labels that links (u, v) between their members (rep, own) join."""
    own = labels.select("rep", "own").distinct()
    for side in ("u", "v"):
        pairs = pairs.join(own.withColumnsRenamed({"rep": side, "own": f"_{side}"}), side).drop(side)
    return components(pairs.select(F.col("_u").alias("u"), F.col("_v").alias("v")).filter("u <> v"))


def groups(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(docs.mapInArrow(textkit.tidy(_sign(width)), SIGNED_DDL))
    key = ["set_a", "set_b", "n_shingles"]
    usable = signed.filter("doc_id IS NOT NULL AND n_shingles > 0")
    sets = cut(usable.groupBy(*key).agg(F.min("doc_id").alias("rep")))
    nodes = cut(usable.join(sets.withColumnRenamed("rep", "doc_id"), [*key, "doc_id"]).dropDuplicates(["doc_id", *key]).withColumnRenamed("doc_id", "rep"))
    members = nodes.select("rep", F.explode("bands").alias("key")).distinct()
    crowded = members.groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("rep").alias("least")).filter("weight > 1")
    members = members.join(crowded, "key").withColumn("blocks", F.ceil(F.col("weight") / BUCKET_BLOCK))
    found = _connected(cut(members.join(nodes.select("rep", "n_shingles", "signature"), "rep")), percent, False, BUCKET_BLOCK)

    # the clusters, with their full sets
    own = found.select(F.col("node").alias("rep"), F.col("component").alias("key"))
    own = own.unionByName(own.select(F.col("key").alias("rep"), "key").distinct())
    own = cut(own.join(nodes.select("rep", *key, "signature"), "rep"))
    weights = own.groupBy("key").agg(F.sum("n_shingles").alias("weight"))
    total = own.agg(F.sum("n_shingles")).first()[0] or 0
    # an even share of a task, so that one cluster is dealt to as many tasks as it is worth
    share = min(CLUSTER_BLOCK, max(1, total // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    rows = own.join(weights, "key").withColumn("least", F.col("key")).withColumn("blocks", F.ceil(F.col("weight") / share))
    full = docs.join(own.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), "text")
    full = full.mapInArrow(textkit.tidy(_sets_of(width)), "rep long, set_a long, set_b long, members array<long>")
    rows = cut(rows.join(full, ["rep", "set_a", "set_b"]).dropDuplicates(["rep", "set_a", "set_b"]))

    # a document of several texts links their sets
    of = usable.join(sets, key).select("doc_id", "rep")
    several = of.groupBy("doc_id").agg(F.min("rep").alias("u"), F.max("rep").alias("last")).filter("u < last").drop("last")
    bound = several.join(of, "doc_id").select("u", F.col("rep").alias("v")).filter("u <> v")
    found = _connected(rows, percent, True, CLUSTER_BLOCK, bound)

    named = _labelled(found, sets, "rep", "component_id").select(*key, "component_id")
    out = signed.join(named, key, "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are kept, with all their columns; all rows of a kept doc_id stay."""
    kept = groups(docs, width, percent).filter("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__id")).distinct()
    unique = docs.filter("doc_id IS NOT NULL")
    rows = unique.join(kept, unique["doc_id"].cast("long") == kept["__id"], "left_semi")
    return rows.unionByName(docs.filter("doc_id IS NULL"))


def op1_near_dedup(spark, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"))
