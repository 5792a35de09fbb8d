"""Queries of touches, the store, interval joins, trees as relations and located references."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktum.registry import dealt, query, table


@query(
    """WITH RECURSIVE t AS (SELECT user_id, min(ts) AS ts FROM events GROUP BY user_id
  UNION ALL SELECT e.user_id, min(e.ts) FROM t JOIN events e ON e.user_id = t.user_id AND e.ts >= t.ts + INTERVAL 1 DAY GROUP BY e.user_id)
SELECT user_id, epoch_us(ts) AS touched_us FROM t"""
)
def inc_touches(spark, sf_dir):
    """INC-4: a user's events that count as a touch, one in 24 hours at most."""
    from faktum.streaming.touches import touches

    return touches(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", F.unix_micros("ts").alias("touched_us"))


@query(
    """WITH d AS (SELECT DISTINCT sha256(text) AS key, length(text) AS n FROM documents WHERE text IS NOT NULL)
SELECT key[1:2] AS shard, count(*) FILTER (n >= 200) AS stored, CAST(coalesce(sum(n) FILTER (n >= 200), 0) AS BIGINT) AS n, CAST(0 AS BIGINT) AS missing FROM d GROUP BY 1 HAVING count(*) FILTER (n >= 200) > 0"""
)
def inc_store(spark, sf_dir):
    """INC-2, 3, 5: documents' lengths stored in two batches, the second one twice; what is short counts as transient; nothing that is stored is missing after."""
    from faktum.streaming.store import Store, scratch

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2("text", 256).alias("key"))
    store = Store(spark, scratch(spark), 2)
    compute = lambda rows: rows.select("key", F.length("text").alias("n"), (F.length("text") < 200).alias("transient"))
    half = F.pmod(F.hash("doc_id"), F.lit(2)) == 0
    store.add(docs.filter(half), 0, compute)
    for _ in range(2):
        store.add(docs, 1, compute)
    missing = store.missing(docs).filter(F.length("text") >= 200).groupBy(F.substring("key", 1, 2).alias("shard")).agg(F.count(F.lit(1)).alias("missing"))
    stored = store.facts().groupBy(F.substring("key", 1, 2).alias("shard")).agg(F.count(F.lit(1)).alias("stored"), F.sum("n").alias("n"))
    return stored.join(missing, "shard", "left").select("shard", "stored", "n", F.coalesce("missing", F.lit(0)).alias("missing"))


_SPANS = "s AS (SELECT o_custkey, o_orderkey, epoch(o_orderdate)::BIGINT // 86400 AS a, max(epoch(l_shipdate)::BIGINT // 86400) AS b FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL HAVING b > a)"


def _spans(spark, sf_dir):
    """(o_custkey, o_orderkey, a, b): an order from its day to that of its last shipment."""
    day = lambda c: F.floor(F.unix_timestamp(c) / 86_400)
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(day("l_shipdate")).alias("b"))
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", day("o_orderdate").alias("a"))
    return orders.join(last, F.col("o_orderkey") == F.col("l_orderkey")).filter("b > a").select("o_custkey", "o_orderkey", "a", "b")


@query(
    f"""WITH {_SPANS}, x AS (SELECT o_custkey, l_orderkey, l_linenumber, epoch(l_shipdate)::BIGINT // 86400 AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT s.o_custkey, s.o_orderkey, l_orderkey, l_linenumber FROM s JOIN x ON s.o_custkey = x.o_custkey AND d >= a AND d < b"""
)
def rel_interval_join(spark, sf_dir):
    """REL-J4: each customer's shipments with the orders that are open on their day."""
    from faktum.operators.intervals import overlaps

    day = F.floor(F.unix_timestamp("l_shipdate") / 86_400)
    shipments = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    shipments = shipments.select("o_custkey", "l_orderkey", "l_linenumber", day.alias("c"), (day + 1).alias("d"))
    return overlaps(_spans(spark, sf_dir), shipments, ["o_custkey"], ("a", "b"), ("c", "d")).select("o_custkey", "o_orderkey", "l_orderkey", "l_linenumber")


@query(f"WITH {_SPANS} SELECT x.o_orderkey, CAST(count(*) AS BIGINT) AS n FROM s x JOIN s y ON x.o_custkey = y.o_custkey AND x.a < y.b AND y.a < x.b GROUP BY x.o_orderkey")
def rel_overlap_counts(spark, sf_dir):
    """REL-J4 without pairs: with how many orders of its customer, itself included, an order is open at the same time."""
    from faktum.operators.intervals import overlap_counts

    spans = _spans(spark, sf_dir)
    return overlap_counts(spans, spans, ["o_custkey"], ("a", "b"), "o_orderkey")


def _talks(spark, sf_dir):
    """(source, id, json): a conversation as one document, and the properties of events."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    talks = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    json = F.to_json(F.struct(F.col("conv_id").alias("id"), F.struct(F.size("turns").alias("n")).alias("meta"), "turns"))
    talks = talks.select(F.lit("conversations").alias("source"), F.col("conv_id").alias("id"), json.alias("json"))
    return talks.unionByName(table(spark, sf_dir, "events").select(F.lit("events").alias("source"), F.col("event_id").alias("id"), F.col("props").alias("json")))


_TURNS = "t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS nr, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)"


@query(
    f"""WITH {_TURNS},
c AS (SELECT DISTINCT conv_id, n FROM t)
SELECT 'conversations' AS source, conv_id AS id, unnest(['', 'id', 'meta', 'meta.n', 'turns']) AS path, unnest(['object', 'number', 'object', 'number', 'array']) AS kind, unnest([NULL, conv_id::VARCHAR, NULL, n::VARCHAR, NULL]) AS value FROM c
UNION ALL SELECT 'conversations', conv_id, unnest(['turns.[' || nr || ']', 'turns.[' || nr || '].turn', 'turns.[' || nr || '].role', 'turns.[' || nr || '].text']), unnest(['object', 'number', 'string', 'string']), unnest([NULL, turn::VARCHAR, role, text]) FROM t
UNION ALL SELECT 'events', event_id, '', 'object', NULL FROM events UNION ALL SELECT 'events', event_id, 'k', 'number', json_extract_string(props, '$.k') FROM events"""
)
def jsn_tree_rows(spark, sf_dir):
    """JSN-1: documents flattened to a row for each node."""
    from faktum.operators.trees import flatten

    return flatten(_talks(spark, sf_dir), ["source", "id"], "json").select("source", "id", F.array_join("path", ".").alias("path"), "kind", "value")


@query(
    f"""WITH {_TURNS},
s AS (SELECT conv_id, n, string_agg('{{"role":' || to_json(role) || ',"text":' || to_json(text) || ',"turn":' || turn || '}}', ',' ORDER BY nr) AS turns, max(role) FILTER (nr = 0) AS first_role, max(turn) FILTER (nr = 1) AS second_turn FROM t GROUP BY conv_id, n)
SELECT 'conversations' AS source, conv_id AS id, first_role, CAST(second_turn AS VARCHAR) AS second_turn, CAST(n AS VARCHAR) AS n,
  '{{"id":{{"value":7}},"meta":{{"from":{{"table":"talks"}},"n":' || n || '}},"turns":[' || turns || ']}}' AS json FROM s
UNION ALL SELECT 'events', event_id, NULL, NULL, NULL, '{{"id":{{"value":7}},"k":' || json_extract_string(props, '$.k') || ',"meta":{{"from":{{"table":"talks"}}}}}}' FROM events"""
)
def jsn_tree_edits(spark, sf_dir):
    """JSN-11: looked up by dotted paths with places, inserted with objects on the way and over a number, and put together again."""
    from faktum.operators.trees import assemble, depth_of, flatten, insert, lookup_all

    keys = ["source", "id"]
    # dealt out by document once; everything after meets there
    nodes = dealt(flatten(_talks(spark, sf_dir), keys, "json"), *keys).persist()
    changed = insert(insert(nodes, keys, "meta.from.table", "string", F.lit("talks")), keys, "id.value", "number", F.lit(7))
    found = lookup_all(nodes, keys, {"first_role": "turns[0].role", "second_turn": "turns[1].turn", "n": "meta.n"})
    return assemble(changed, keys, max(3, depth_of(nodes))).join(found, keys, "left").select(*keys, "first_role", "second_turn", "n", "json")


_PAIRS = """p AS (SELECT page_id, html || html AS t, regexp_extract_all(html || html, '<a href="[^"]*">') AS e FROM pages),
q AS (SELECT page_id, t, CASE WHEN page_id % 3 = 1 THEN list_reverse(e) ELSE e END AS e FROM p),
i AS (SELECT page_id, t, list_transform(e, lambda x: CASE WHEN page_id % 3 = 2 AND ends_with(x, 'e">') THEN x || '!' ELSE x END) AS e, list_transform(e, lambda x: x[10:-3]) AS a FROM q WHERE len(e) > 0)"""


@query(
    f"""WITH RECURSIVE {_PAIRS},
s AS (SELECT page_id, 0 AS k, 1 AS cursor, 0 AS spot FROM i
  UNION ALL SELECT page_id, k + 1, CASE WHEN spot > 0 THEN spot ELSE cursor END, spot FROM (SELECT s.page_id, k, cursor, CASE WHEN instr(substring(t, cursor), e[k + 1]) > 0 THEN cursor + instr(substring(t, cursor), e[k + 1]) - 1
    WHEN instr(t, e[k + 1]) > 0 THEN instr(t, e[k + 1]) ELSE instr(t, a[k + 1]) END AS spot FROM s JOIN i ON s.page_id = i.page_id WHERE k < len(e)))
SELECT s.page_id, CAST(k - 1 AS INTEGER) AS ord, a[k] AS href, CAST(CASE WHEN spot > 0 THEN strlen(left(t, spot - 1)) ELSE 0 END AS BIGINT) AS "offset" FROM s JOIN i ON s.page_id = i.page_id WHERE k > 0"""
)
def ref_link_offsets(spark, sf_dir):
    """REF-10, 11: links of pages that stand there twice, in their order, in reverse, and with evidence that isn't there, each with its place."""
    from faktum.functions.locate import locate

    pages = table(spark, sf_dir, "pages").select("page_id", F.concat("html", "html").alias("t"))
    pages = pages.withColumn("e", F.regexp_extract_all("t", F.lit('<a href="[^"]*">'), F.lit(0)))
    pages = pages.withColumn("e", F.when(F.col("page_id") % 3 == 1, F.reverse("e")).otherwise(F.col("e")))
    pages = pages.withColumn("a", F.transform("e", lambda x: F.substring(x, F.lit(10), F.length(x) - 11)))
    pages = pages.withColumn("e", F.transform("e", lambda x: F.when((F.col("page_id") % 3 == 2) & x.endswith('e">'), F.concat(x, F.lit("!"))).otherwise(x)))
    found = pages.select("page_id", F.posexplode(F.arrays_zip(F.col("a"), locate(F.col("t"), F.col("e"), F.col("a")).alias("o"))).alias("ord", "x"))
    return found.select("page_id", "ord", F.col("x.a").alias("href"), F.col("x.o").alias("offset"))


_RECORDS = """r AS (SELECT p_partkey, p_name, p_brand, p_size, max(epoch(l_shipdate)::BIGINT) AS last, min(epoch(l_shipdate)::BIGINT) AS first, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS total, count(DISTINCT l_suppkey) AS suppliers FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY ALL),
f AS (SELECT p_partkey, unnest(['ecosystem', 'name', 'version', 'author', 'title', 'deprecated']) AS key, unnest(['npm', p_name, p_size || '.0', p_brand, CASE WHEN p_partkey % 3 > 0 THEN p_name END, CASE p_partkey % 5 WHEN 0 THEN 'old' WHEN 1 THEN '' END]) AS text, NULL::DOUBLE AS number FROM r
UNION ALL SELECT p_partkey, unnest(['published_at', 'first_published_at', 'previous_published_at', 'release_count', 'downloads_total', 'maintainers', 'rating', 'rating_count', 'has_install_script', 'publisher_verified', 'is_deprecated', 'days_since_previous_release']), NULL,
  unnest([last, first, CASE WHEN n > 1 THEN first + 7 * p_size END, n, total, suppliers, (p_size / 10)::FLOAT::DOUBLE, p_size, (p_size % 2 = 0)::INTEGER, CASE WHEN p_partkey % 2 = 0 THEN 1 END, (p_partkey % 5 < 2)::INTEGER, CASE WHEN n > 1 THEN greatest(last - first - 7 * p_size, 0) // 86400 END]::DOUBLE[]) FROM r)"""


@query(f"WITH {_RECORDS} SELECT p_partkey, 'registry.' || key AS key, text, number FROM f WHERE text <> '' OR number IS NOT NULL")
def jsn_registry_records(spark, sf_dir):
    """JSN-8: records of parts as packages, whose releases are their shipments."""
    from faktum.operators.registry_records import facts

    at = F.unix_timestamp("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.max(at).alias("last"), F.min(at).alias("first"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("total"), F.countDistinct("l_suppkey").alias("suppliers"))
    rows = table(spark, sf_dir, "part").join(lines, F.col("p_partkey") == F.col("l_partkey"))
    key, size = F.col("p_partkey"), F.col("p_size")
    record = F.struct(
        F.lit("npm").alias("ecosystem"), F.col("p_name").alias("name"), F.concat(size, F.lit(".0")).alias("version"), F.col("p_brand").alias("author"), F.when(key % 3 > 0, F.col("p_name")).alias("title"), F.when(key % 5 == 0, "old").when(key % 5 == 1, "").alias("deprecated"),
        F.col("last").alias("published_at"), F.col("first").alias("first_published_at"), F.when(F.col("n") > 1, F.col("first") + 7 * size).alias("previous_published_at"), F.col("n").alias("release_count"), F.col("total").alias("downloads_total"), F.col("suppliers").alias("maintainers"),
        (size / 10).alias("rating"), size.alias("rating_count"), (size % 2 == 0).alias("has_install_script"), F.when(key % 2 == 0, True).alias("publisher_verified"), F.lit("more").alias("unknown_field"),
    )
    return facts(rows.select("p_partkey", F.to_json(record).alias("json")), ["p_partkey"], "json")
