"""JSON documents as relations: a row for each node with its path, looked up, changed and put together again as tables.

A path is an array of segments from the root: keys as they are, places of arrays
as `[i]`.  A row has the keys of its document, its path, its kind (object, array,
string, number, boolean, null) and, for scalars, its value as text.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_NODES = "array<struct<path:array<string>,kind:string,value:string>>"


def segments(path: str) -> list[str]:
    """A dotted path with `[i]` for places; brackets that hold no number belong to the key."""
    out = []
    for part in path.split("."):
        found = re.fullmatch(r"([^\[]*)\[\+?(\d+)\]", part)
        out += [x for x in (found[1], f"[{int(found[2])}]") if x] if found else [part] if part else []
    return out


def _kind(v: Column) -> Column:
    name = F.schema_of_variant(v)
    return (
        F.when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "array").when(name == "STRING", "string").when(name == "BOOLEAN", "boolean").when(name.isNull() | (name == "VOID"), "null").otherwise("number")
    )


def flatten(docs: DataFrame, keys: list[str], json: str) -> DataFrame:
    """(keys, path, kind, value) of every node; documents that are no JSON, or null, are left out.

    Each level of nesting is one explode of the containers of the level above, until none has any.
    """
    spark = docs.sparkSession
    level = docs.select(*keys, F.array().cast("array<string>").alias("path"), F.try_parse_json(json).alias("v")).filter("v IS NOT NULL")
    out = None
    while True:
        level = level.withColumn("kind", _kind(F.col("v")))
        scalar = F.when(~F.col("kind").isin("object", "array", "null"), F.try_variant_get("v", "$", "string"))
        rows = level.select(*keys, "path", "kind", scalar.alias("value"))
        out = rows if out is None else out.unionByName(rows)
        containers = level.filter(F.col("kind").isin("object", "array"))
        below = containers.select(*keys, "path", F.col("v").alias("_v")).lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
        level = below.select(*keys, F.array_append("path", F.coalesce(F.col("key"), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]")))).alias("path"), F.col("value").alias("v"))
        if level.isEmpty():
            return out


def _literal(path: list[str]) -> Column:
    return F.array(*map(F.lit, path)).cast("array<string>")


def _under(path: list[str]) -> Column:
    return F.slice("path", 1, len(path)) == _literal(path) if path else F.lit(True)


def lookup(nodes: DataFrame, keys: list[str], path: str) -> DataFrame:
    """(keys, kind, value) of the node at a dotted path, of the documents that have one."""
    return nodes.filter(F.col("path") == _literal(segments(path))).select(*keys, "kind", "value")


def lookup_all(nodes: DataFrame, keys: list[str], paths: dict[str, str]) -> DataFrame:
    """(keys, a column for each name): the values of the nodes at dotted paths, of all documents, in one grouping."""
    at = {name: F.col("path") == _literal(segments(path)) for name, path in paths.items()}
    return nodes.groupBy(*keys).agg(*(F.max(F.when(own, F.col("value"))).alias(name) for name, own in at.items()))


def insert(nodes: DataFrame, keys: list[str], path: str, kind: str, value: Column | None = None) -> DataFrame:
    """nodes with a node put at a dotted path (places aren't known here): objects are made on the way, and what is no object there goes.

    What stands on the way is told to all nodes of a document by a window, and its first node brings the new ones; nodes
    that are dealt out by their keys stay where they are.
    """
    own = path.split(".")
    whole = W.partitionBy(*keys)
    on_way = F.array(*(F.coalesce(F.max(F.when(F.col("path") == _literal(own[:k]), F.col("kind"))).over(whole), F.lit("")) for k in range(len(own))))
    marked = nodes.select(*keys, "path", "kind", "value", on_way.alias("_way"), F.row_number().over(whole.orderBy(F.size("path"))).alias("_nr"))
    # the first place on the way that has no object; from there on all is made anew
    at = (F.array_position(F.transform("_way", lambda x: x == "object"), False) - 1).cast("int")
    marked = marked.withColumn("_at", F.when(at < 0, len(own)).otherwise(at))
    gone = F.lit(False)
    for k in range(len(own) + 1):
        gone = gone | ((F.col("_at") == k) & _under(own[:k]))
    node = lambda path, kind, value: F.struct(path.alias("path"), kind.alias("kind"), value.cast("string").alias("value"))
    none = F.lit(None).cast("string")
    objects = F.concat(*(F.when(F.col("_at") <= k, F.array(node(_literal(own[:k]), F.lit("object"), none))).otherwise(F.array().cast(_NODES)) for k in range(len(own))))
    made = F.concat(objects, F.array(node(_literal(own), F.lit(kind), none if value is None else value)))
    kept = F.when(gone, F.array().cast(_NODES)).otherwise(F.array(node(F.col("path"), F.col("kind"), F.col("value"))))
    return marked.select(*keys, F.inline(F.when(F.col("_nr") == 1, F.concat(kept, made)).otherwise(kept)))


def depth_of(nodes: DataFrame) -> int:
    return nodes.agg(F.max(F.size("path"))).first()[0] or 0


def assemble(nodes: DataFrame, keys: list[str], deepest: int | None = None) -> DataFrame:
    """(keys, json): documents as text, keys in order; no path is longer than `deepest`, if that is known.  From the deepest level up, each node is grouped with its children; nodes that are dealt out by their keys stay where they are."""
    text = lambda x: F.expr(f"substring(to_json(named_struct('v', {x})), 6, length(to_json(named_struct('v', {x}))) - 6)")
    own = F.when(F.col("kind") == "string", text("value")).when(F.col("kind") == "null", "null").when(F.col("kind").isin("object", "array"), F.lit(None)).otherwise(F.col("value"))
    leaf = F.when(F.col("kind") == "object", "{}").when(F.col("kind") == "array", "[]").otherwise(own)
    rows = nodes.select(*keys, "path", "kind", leaf.alias("json"))
    for depth in range(depth_of(nodes) if deepest is None else deepest, 0, -1):
        below = F.size("path") == depth
        place = F.element_at("path", -1)
        child = F.struct(F.coalesce(F.try_to_number(F.regexp_extract(place, r"\A\[(\d+)\]\z", 1), F.lit("9999999999")).cast("long"), F.lit(-1)).alias("at"), place.alias("own"), "json")
        met = rows.groupBy(*keys, F.when(below, F.slice("path", 1, depth - 1)).otherwise(F.col("path")).alias("path")).agg(
            F.max(F.when(~below, F.struct("kind", "json"))).alias("_own"), F.collect_list(F.when(below, child)).alias("_children")
        )
        pairs = F.transform(F.array_sort(F.transform("_children", lambda x: F.struct(x["own"].alias("own"), x["json"].alias("json")))), lambda x: F.concat(_quoted(x["own"]), F.lit(":"), x["json"]))
        values = F.transform(F.array_sort("_children"), lambda x: x["json"])
        kind, some = F.col("_own.kind"), F.size("_children") > 0
        whole = F.when(some & (kind == "object"), F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).when(some & (kind == "array"), F.concat(F.lit("["), F.array_join(values, ","), F.lit("]"))).otherwise(F.col("_own.json"))
        rows = met.filter("_own IS NOT NULL").select(*keys, "path", kind.alias("kind"), whole.alias("json"))
    return rows.filter(F.size("path") == 0).select(*keys, "json")


def _quoted(x: Column) -> Column:
    own = F.to_json(F.struct(x.alias("v")))
    return F.substring(own, F.lit(6), F.length(own) - 6)
