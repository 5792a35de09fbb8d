"""Views as a caller takes them: JSON documents, and metrics by namespace."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_documents(rows: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, json): each row as a JSON document; fields that are null are left out."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON document a line, as many files as rows has partitions."""
    rows.write.mode("errorifexists").json(path)


def by_namespace(metrics: DataFrame) -> DataFrame:
    """metrics (file_id, key, value) with the namespace, which is what stands before the first dot, and the name after it."""
    dot = F.instr("key", ".")
    return metrics.select("file_id", F.when(dot > 0, F.split_part("key", F.lit("."), F.lit(1))).otherwise("").alias("namespace"), F.when(dot > 0, F.expr("substring(key, instr(key, '.') + 1)")).otherwise(F.col("key")).alias("name"), "value")


def namespaces(metrics: DataFrame) -> DataFrame:
    """How many metrics of each namespace a file has."""
    return by_namespace(metrics).groupBy("file_id", "namespace").agg(F.count(F.lit(1)).alias("n"))


def previews(rows: DataFrame, keys: list[str], item: str, limit: int) -> DataFrame:
    """(keys, shown, hidden): the first `limit` items of each list, ascending, and the number of the others.

    Lists are cut within each partition before they are shuffled, so no list is ever held whole.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(*keys).orderBy(item))
    first = rows.select(*keys, item).withColumn("place", place).filter(F.col("place") <= limit)
    shown = first.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("shown"))
    total = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    same = [shown[k].eqNullSafe(total[k]) for k in keys]
    return shown.join(total, same).select(*(shown[k] for k in keys), "shown", F.greatest(F.col("n") - limit, F.lit(0)).alias("hidden"))


#: The views that a caller can ask for one of, and the kind of symbols that some of them are.
PARTS = ("fileid", "values", "text", "literals", "metrics", "sections", "symbols", "identity", "errors")
SYMBOLS = {"imports": "import", "exports": "export", "functions": "function", "calls": "call", "members": "member", "binds": "bind", "identifiers": "identifier"}
SCHEMA_VERSION = "8"


def chosen(views: list[str]) -> str:
    """The one view that selectors name; `all` without any.  A ValueError tells unknown ones and several different ones."""
    for view in views:
        if view not in PARTS and view not in SYMBOLS and view != "all":
            raise ValueError(f"unknown view: {view}")
    if len(set(views)) > 1:
        raise ValueError(f"one view at a time: {', '.join(sorted(set(views)))}")
    return views[0] if views else "all"


def view_json(bundles: DataFrame, views: list[str], key: str = "file_id") -> DataFrame:
    """(key, json) of the view that is asked for.

    bundles has a column for each of PARTS that it knows; `symbols` is an array of structs with a kind.  Of all views each
    known part is a field; a part that bundles lacks, or that is null, is an empty list.  Only the columns that a view
    needs are read.
    """
    view = chosen(views)
    part = lambda name: F.coalesce(F.to_json(F.col(name)), F.lit("[]")) if name in bundles.columns else F.lit("[]")
    if view in SYMBOLS:
        own = F.filter("symbols", lambda x: x["kind"] == SYMBOLS[view]) if "symbols" in bundles.columns else None
        text = F.lit("[]") if own is None else F.coalesce(F.to_json(own), F.lit("[]"))
    elif view == "all":
        fields = [x for name in PARTS for x in (F.lit(f',"{name}":'), part(name))]
        text = F.concat(F.lit(f'{{"schema_version":"{SCHEMA_VERSION}"'), *fields, F.lit("}"))
    else:
        text = part(view)
    return bundles.select(key, text.alias("json"))
