"""Queries of inline scripts: syntax trees, operators, comments, literals and identifiers of pages, and of pages made of orders, whose right answers follow from their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faktum.queries_sources import _BODIES, _CMT_METRICS, CODE
from faktum.queries_text import _LITERALS, _NAMES_SQL, NAMES, STRINGS
from faktum.registry import dealt, query, spread, table, values

#: What an order's lines become, by their flag.
_ITEMS = {"R": "f(x.y.z, {q});", "A": "a += 1;", "N": "b = b ^ (k % 3);"}


def order_pages(spark, sf_dir) -> DataFrame:
    """(source, id, html): an order as a page with a script, a style and comments; strings hold what looks like tags and comments."""
    number = lambda c: F.col(c).cast("long").cast("string")
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    lines, orders = dealt(lines.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("q"), "l_returnflag"), "l_orderkey", of=(orders,)), dealt(orders, "o_orderkey", of=(lines,))
    line = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("f(x.y.z, "), number("q"), F.lit(");"))).when(F.col("l_returnflag") == "A", _ITEMS["A"]).otherwise(_ITEMS["N"])
    items = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", number("q").alias("q"), line.alias("line")))).alias("items"))
    rows = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    key, status = number("o_orderkey"), F.col("o_orderstatus")
    parts = [
        "<html><!-- order ", key, " --><script type='module'>/* order ", key, " TODO ", F.col("o_orderpriority"), " */\nvar o", key, " = [", F.array_join(F.col("items.q"), ", "), "];\n// see http://x.org/", number("o_custkey"), " ", status,
        "\ntrack(o", key, ".length, \"", status, "</p><!-- no -->\", `c${", number("o_custkey"), "}`);\n", F.array_join(F.col("items.line"), "\n"), "\nlet s = \"a\" + \"b\" + ", key, " + 'c';\nif (o", key, " === o", key, ") for (;;) g();\n",
        "var h = function (q) { return q; }, e = () => \"", F.col("o_orderpriority"), "\";\n</script><style>p{margin:0} /* HACK */</style></html>",
    ]
    return rows.select(F.lit("orders").alias("source"), F.col("o_orderkey").alias("id"), F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts)).alias("html"))


def all_pages(spark, sf_dir) -> DataFrame:
    own = table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), "html")
    return spread(own).unionByName(order_pages(spark, sf_dir))


def _elements(spark, sf_dir) -> DataFrame:
    from faktum.sources.scripts import elements

    pages = all_pages(spark, sf_dir).select(F.struct("source", "id").alias("key"), "html")
    return elements(pages, "key", "html").select("key.source", "key.id", "ord", "kind", "body")


def _scripts(spark, sf_dir, source: str = "source") -> DataFrame:
    return _elements(spark, sf_dir).filter(f"kind = 'script' AND source = {source}")


def _names(spark, sf_dir, kind: str) -> DataFrame:
    """(file_id, name, n) of the scripts' nodes of a kind; pages have negative numbers."""
    from faktum.sources.scripts import names

    scripts = _elements(spark, sf_dir).filter("kind = 'script'").select(F.when(F.col("source") == "orders", F.col("id")).otherwise(-1 - F.col("id")).alias("file_id"), "body")
    return names(scripts, ["file_id"], "body", kind)


#: By order: how many lines it has, and of each kind.
_LINES = """l AS (SELECT o_orderkey AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS r, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS x FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey),
p AS (SELECT page_id AS id, html, len(regexp_extract_all(left(html, instr(html, '<script>')), '<!--|<style')) AS ord FROM pages WHERE regexp_matches(html, '<script>var t="</p>";track\\([0-9]+\\);</script>'))"""


@query(
    f"""WITH {_LINES},
m AS (SELECT 'orders' AS source, id, 1 AS ord, 47 + n + 4 * a + 9 * x + 7 * r AS node_count, 6 AS max_depth, 2 + r AS call_count, CASE WHEN r > 0 THEN 3 ELSE 2 END AS member_depth_max, 4 AS string_concat_chain_max_length, n AS array_literal_max_length,
  CASE WHEN n > 1 THEN n END AS numeric_array_max_length, 4 + a + x AS bind_count, CASE WHEN r > 0 THEN 3 ELSE 1 END AS member_count, 7 + CASE WHEN r > 0 THEN 2 ELSE 0 END + CASE WHEN a > 0 THEN 1 ELSE 0 END + CASE WHEN x > 0 THEN 2 ELSE 0 END AS identifier_count,
  1 AS identity_function_count, 1 AS string_return_function_count, 0.5::DOUBLE AS string_return_function_ratio, 1 AS const_return_function_count, 0.5::DOUBLE AS const_return_function_ratio, 1 AS self_compare_count, 1 AS infinite_loop_count FROM l
UNION ALL SELECT 'pages', id, ord, 9, 3, 1, NULL, NULL, NULL, NULL, 1, NULL, 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p)
SELECT source, id, CAST(ord AS INTEGER) AS ord, CAST(node_count AS BIGINT) AS node_count, CAST(max_depth AS INTEGER) AS max_depth, NULL::INTEGER AS depth_capped, CAST(call_count AS BIGINT) AS call_count, CAST(member_depth_max AS INTEGER) AS member_depth_max,
  CAST(string_concat_chain_max_length AS INTEGER) AS string_concat_chain_max_length, CAST(array_literal_max_length AS INTEGER) AS array_literal_max_length, CAST(numeric_array_max_length AS INTEGER) AS numeric_array_max_length, CAST(bind_count AS BIGINT) AS bind_count,
  CAST(member_count AS BIGINT) AS member_count, CAST(identifier_count AS BIGINT) AS identifier_count, NULL::BIGINT AS sequence_count, NULL::INTEGER AS numeric_sequence_max_length, CAST(identity_function_count AS BIGINT) AS identity_function_count,
  CAST(string_return_function_count AS BIGINT) AS string_return_function_count, string_return_function_ratio, CAST(const_return_function_count AS BIGINT) AS const_return_function_count, const_return_function_ratio,
  CAST(self_compare_count AS BIGINT) AS self_compare_count, CAST(infinite_loop_count AS BIGINT) AS infinite_loop_count FROM m"""
)
def src_script_trees(spark, sf_dir):
    """AST-1..11, 14..17, 19..23 of each inline script."""
    from faktum.operators.script_sums import tree_metrics

    return tree_metrics(_scripts(spark, sf_dir), ["source", "id", "ord"], "body")


@query(
    f"""WITH {_LINES}, m AS (SELECT id, unnest(['add', 'eq', 'xor', 'mod']) AS op, unnest([3 + a, 1, x, x]) AS n, 47 + n + 4 * a + 9 * x + 7 * r AS nodes FROM l)
SELECT 'orders' AS source, id, CAST(1 AS INTEGER) AS ord, op, CAST(n AS BIGINT) AS n, round(n / nodes, 6) AS density FROM m WHERE n > 0"""
)
def src_script_operators(spark, sf_dir):
    """AST-12, 13: operators of each script."""
    from faktum.operators.script_sums import operator_counts

    return operator_counts(_scripts(spark, sf_dir), ["source", "id", "ord"], "body")


_PAGE_BODIES = """(SELECT 'orders' || o_orderkey AS file_id, unnest([0, 1, 2, 3]) AS ord, unnest([' order ' || o_orderkey || ' ', ' order ' || o_orderkey || ' TODO ' || o_orderpriority || ' ', ' see http://x.org/' || o_custkey || ' ' || o_orderstatus, ' HACK ']) AS body FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT 'pages' || page_id, unnest(range(0, len(b))), unnest(b) FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--(.*?)-->', 1) AS b FROM pages))"""
_PAGE_TEXTS = "(SELECT 'orders' || l_orderkey AS file_id, repeat('x' || chr(10), 8 + count(*)) AS text FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey UNION ALL SELECT 'pages' || page_id, html FROM pages)"


@query(_CMT_METRICS.replace(values("file_id, ord, body", *_BODIES), _PAGE_BODIES).replace(values("file_id, file_type, text", *CODE), _PAGE_TEXTS))
def cmt_pages(spark, sf_dir):
    """CMT-1..13 of each page: comments of its markup, scripts and styles."""
    from faktum.operators.comments import metrics
    from faktum.functions.text import line_count
    from faktum.sources.scripts import comment_bodies, elements, plain_comments

    key = F.struct(F.concat("source", "id").alias("file_id"), line_count(F.col("html")).alias("all_lines"))
    parts = elements(all_pages(spark, sf_dir).select(key.alias("key"), "html"), "key", "html").withColumn("plain", plain_comments(F.when(F.col("kind") == "script", F.col("body"))))
    script = F.coalesce("plain", comment_bodies(F.when((F.col("kind") == "script") & F.col("plain").isNull(), F.col("body"))))
    own = F.when(F.col("kind") == "script", script).when(F.col("kind") == "style", F.regexp_extract_all("body", F.lit(r"(?s)/\*(.*?)\*/"), F.lit(1))).otherwise(F.array("body"))
    return metrics(parts.select("key.file_id", "key.all_lines", "ord", F.explode(own).alias("body")))


_OF_PARTS = "SELECT p_partkey AS file_id, unnest(string_split(p_name || '  ' || p_brand || ' ' || p_type, ' ')) AS s FROM part UNION ALL SELECT -1, s FROM " + values("s", *((x,) for x in STRINGS)) + " UNION ALL"
_PAGE_STRINGS = """SELECT o_orderkey AS file_id, unnest([o_orderstatus || '</p><!-- no -->', 'a', 'b', 'c', o_orderpriority]) AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT -1 - page_id, '</p>' FROM pages UNION ALL"""
assert _OF_PARTS in _LITERALS


@query(_LITERALS.replace(_OF_PARTS, _PAGE_STRINGS))
def lit_scripts(spark, sf_dir):
    """LIT metrics of the string literals of each page's scripts (pages have negative numbers; -2 is a fixed case)."""
    from faktum.operators.names import literal_metrics

    own = _names(spark, sf_dir, "string").select("file_id", F.explode(F.array_repeat("name", F.col("n").cast("int"))).alias("value"))
    long_ = spark.range(30).select(F.lit(-2).cast("long").alias("file_id"), F.expr("repeat(concat(chr(97 + id % 26), id, 'Qz'), 40)").alias("value"))
    return literal_metrics(own.unionByName(long_))


_PART_NAMES = "SELECT p_partkey AS file_id, unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS s FROM part UNION ALL SELECT -1, s FROM " + values("s", *((x,) for x in NAMES))
_PAGE_NAMES = """SELECT o_orderkey AS file_id, unnest(['o' || o_orderkey, 'track', 'o' || o_orderkey, 's', 'o' || o_orderkey, 'o' || o_orderkey, 'g', 'h', 'q', 'q', 'e']) AS s FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
UNION ALL SELECT l_orderkey, unnest(CASE l_returnflag WHEN 'R' THEN ['f', 'x'] WHEN 'A' THEN ['a'] ELSE ['b', 'b', 'k'] END) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) UNION ALL SELECT -1 - page_id, unnest(['t', 'track']) FROM pages"""
assert _PART_NAMES in _NAMES_SQL


@query(_NAMES_SQL.replace(_PART_NAMES, _PAGE_NAMES))
def idn_scripts(spark, sf_dir):
    """IDN metrics of the identifiers of each page's scripts."""
    from faktum.operators.names import identifier_metrics

    return identifier_metrics(_names(spark, sf_dir, "identifier"))


#: Patterns by name; the last two can't be read.
_IN_PAGES = {"links of menus": "nav//li/a", "bold paragraphs": "article/p[b]", "scripts beside styles": "head[style]/script", "broken lines": "body[footer]//p[.//br]", "no step": "nav[//", "no end": "ul[li"}
_IN_SCRIPTS = {"xor with modulo": "binary:^//binary:%", "returned names": "declaration/declare[function[params/identifier]]//return/identifier", "added strings": "declare/binary:+[.//string]"}


@query(
    f"""WITH {_LINES}, c AS (SELECT page_id AS id, len(regexp_extract_all(html, '<li><a')) AS a, len(regexp_extract_all(html, '<p><b>')) AS b FROM pages)
SELECT pattern, source, id, CAST(n AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS error FROM (SELECT 'links of menus' AS pattern, 'pages' AS source, id, a AS n FROM c UNION ALL SELECT 'bold paragraphs', 'pages', id, b FROM c UNION ALL SELECT 'broken lines', 'pages', id, b FROM c
  UNION ALL SELECT 'scripts beside styles', 'pages', id, 1 FROM c UNION ALL SELECT 'xor with modulo', 'orders', id, x FROM l UNION ALL SELECT unnest(['returned names', 'added strings']), 'orders', id, 1 FROM l) WHERE n > 0
UNION ALL SELECT 'no step', NULL, NULL, NULL, 'a step is missing at 4' UNION ALL SELECT 'no end', NULL, NULL, NULL, 'a bracket is not closed'"""
)
def src_tree_patterns(spark, sf_dir):
    """§2.18: tree patterns over the elements of pages and the scripts of orders; those that can't be read give an error row."""
    from faktum.operators import script_sums
    from faktum.operators.twigs import kinds_of, match_all
    from faktum.sources import markup

    fields = ["node", "parent", "last", "kind", "op"]
    pages = markup.nodes(spread(table(spark, sf_dir, "pages").select(F.lit("pages").alias("source"), F.col("page_id").alias("id"), "html")), ["source", "id"], "html", fields, kinds_of(list(_IN_PAGES.values())))
    return match_all(pages, ["source", "id"], _IN_PAGES).unionByName(script_sums.match_all(_scripts(spark, sf_dir, "'orders'"), ["source", "id"], "body", _IN_SCRIPTS))


#: What all scripts of pages have in common; the call's argument is their own.
_PAGE_SYMBOLS = '{"kind":"bind","name":"t","offset":4},{"kind":"identifier","name":"t","offset":4},{"kind":"call","name":"track()","offset":13},{"kind":"identifier","name":"track","offset":13}'
_PAGE_VIEWS = ("fileid", "literals", "metrics", "sections", "symbols", "calls", "binds", "identifiers", "exports", "all")


@query(
    f"""WITH v AS (SELECT page_id, '{{"path":"' || url || '","type":"html"}}' AS f, '{{"size_bytes":' || strlen(html) || ',"scripts":1}}' AS m FROM pages)
SELECT page_id, view, CASE view WHEN 'fileid' THEN f WHEN 'literals' THEN '["</p>"]' WHEN 'metrics' THEN m WHEN 'symbols' THEN '[{_PAGE_SYMBOLS}]' WHEN 'calls' THEN '[{{"kind":"call","name":"track()","offset":13}}]' WHEN 'binds' THEN '[{{"kind":"bind","name":"t","offset":4}}]'
  WHEN 'identifiers' THEN '[{{"kind":"identifier","name":"t","offset":4}},{{"kind":"identifier","name":"track","offset":13}}]' WHEN 'all' THEN '{{"schema_version":"8","fileid":' || f || ',"values":[],"text":[],"literals":["</p>"],"metrics":' || m || ',"sections":[],"symbols":[{_PAGE_SYMBOLS}],"identity":[],"errors":[]}}' ELSE '[]' END AS json
FROM v, (SELECT unnest({list(_PAGE_VIEWS)!r}) AS view)"""
)
def snk_views(spark, sf_dir):
    """SNK-1: views of pages as JSON, by selector: what they are, measures, and literals and symbols of their scripts."""
    from functools import reduce

    from faktum.plans.views import view_json
    from faktum.sources.scripts import elements, nodes

    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    found = nodes(elements(pages, "page_id", "html").filter("kind = 'script'"), ["page_id", "ord"], "body")
    kind = F.when(F.col("kind").isin("assign", "declare"), "bind").otherwise(F.col("kind"))
    symbol = F.when(F.col("name").isNotNull() & kind.isin("bind", "identifier", "call", "member", "function"), F.struct("ord", "node", kind.alias("kind"), "name", F.col("start").alias("offset")))
    literal_ = F.when(F.col("kind") == "string", F.struct("ord", "node", "name"))
    by_page = found.groupBy("page_id").agg(F.array_sort(F.collect_list(symbol)).alias("s"), F.array_sort(F.collect_list(literal_)).alias("l"), F.count_distinct("ord").alias("scripts"))
    symbols = F.transform("s", lambda x: F.struct(x["kind"].alias("kind"), x["name"].alias("name"), x["offset"].alias("offset")))
    bundles = pages.join(by_page, "page_id", "left").select(
        "page_id", F.struct(F.col("url").alias("path"), F.lit("html").alias("type")).alias("fileid"), F.struct(F.octet_length("html").alias("size_bytes"), "scripts").alias("metrics"), F.col("l.name").alias("literals"), symbols.alias("symbols")
    )
    return reduce(lambda a, b: a.unionByName(b), (view_json(bundles, [v], "page_id").select("page_id", F.lit(v).alias("view"), "json") for v in _PAGE_VIEWS))
