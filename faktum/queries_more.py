"""Queries of strings, symbols, views and anomalies that build on the other operators."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from faktum.functions import bytes as B
from faktum.functions import text as T
from faktum.operators.names import entropy
from faktum.registry import lines, lines_sql, query, rows, table, values


def string_metrics(strings):
    """strings: (file_id, s).  Counts, lengths and entropies of the strings of each file."""
    s = strings.withColumn("n", F.octet_length("s")).withColumn("e", entropy(F.col("s")))
    return s.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("string_count"),
        F.max("n").alias("max_string_length"),
        F.round(F.avg("n"), 6).alias("avg_string_length"),
        F.round(F.stddev_pop("n"), 6).alias("string_length_stddev"),
        F.count_if(F.round("e", 9) >= 6.0).alias("high_entropy_string_count"),
        F.count_if(T.sentence_like(F.col("s"))).alias("sentence_string_count"),
        F.round(F.count_if(T.sentence_like(F.col("s"))) / F.count(F.lit(1)), 6).alias("sentence_string_ratio"),
    )


@query(
    r"""WITH s AS (SELECT doc_id AS file_id, unnest(regexp_extract_all(text, '[\x20-\x7e\t]{4,}')) AS s FROM documents), k AS (SELECT DISTINCT s FROM s),
e AS (SELECT s, -sum((n / m) * log2(n / m)) + 0.0 AS e FROM (SELECT s, strlen(s) AS m, x, count(*) AS n FROM (SELECT s, unnest(regexp_extract_all(hex(encode(s)), '..')) AS x FROM k) GROUP BY ALL) GROUP BY s),
t AS (SELECT file_id, s.s, e, strlen(s.s) AS n, list_filter(regexp_split_to_array(s.s, '[ \t]+'), lambda x: x <> '') AS ts FROM s JOIN e ON s.s = e.s),
u AS (SELECT *, n >= 12 AND len(regexp_extract_all(s, ' ')) >= 2 AND len(ts) >= 3 AND len(list_filter(ts, lambda x: len(regexp_extract_all(x, '[A-Za-z]')) >= 2)) >= 2 AS sentence FROM t)
SELECT file_id, count(*) AS string_count, max(n)::INTEGER AS max_string_length, round(avg(n), 6) AS avg_string_length, round(stddev_pop(n), 6) AS string_length_stddev, count(*) FILTER (round(e, 9) >= 6.0) AS high_entropy_string_count, count(*) FILTER (sentence) AS sentence_string_count, round(count(*) FILTER (sentence) / count(*), 6) AS sentence_string_ratio FROM u GROUP BY file_id"""
)
def agg_strings(spark, sf_dir):
    """AGG-10..16 over the printable strings of documents."""
    found = B.printable_strings(F.encode("text", "UTF-8"))
    return string_metrics(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.explode(found).alias("s")))


RECTANGLES = ((1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 5.0, 5.0, 15.0, 15.0), (1, 2, 10.0, 10.0, 20.0, 20.0), (1, 3, 9.0, 9.0, 1.0, 1.0), (2, 0, 0.0, 0.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 5.0, 5.0))
_RECTANGLES = f"(SELECT * FROM {values('file_id, ord, x1, y1, x2, y2', *RECTANGLES)} UNION ALL SELECT 1000 + l_orderkey, l_linenumber, l_partkey % 50, l_suppkey % 40, l_quantity, l_suppkey % 40 - l_linenumber * 3 FROM lineitem) AS t"


@query(
    f"""WITH r AS (SELECT file_id, ord, least(x1, x2) AS a, greatest(x1, x2) AS b, least(y1, y2) AS c, greatest(y1, y2) AS d FROM {_RECTANGLES})
SELECT p.file_id, count(*) AS overlapping_pairs FROM r p JOIN r q ON p.file_id = q.file_id AND p.ord < q.ord AND p.a < q.b AND q.a < p.b AND p.c < q.d AND q.c < p.d WHERE p.ord < 2000 AND q.ord < 2000 GROUP BY p.file_id"""
)
def anm_overlapping_fields(spark, sf_dir):
    """ANM-22: pairs of a form's rectangles that overlap, among its first 2,000 fields (the operator's own limit)."""
    r = rows(spark, "file_id long, ord long, x1 double, y1 double, x2 double, y2 double", *RECTANGLES)
    line = table(spark, sf_dir, "lineitem").select((1000 + F.col("l_orderkey")).alias("file_id"), F.col("l_linenumber").cast("long").alias("ord"), (F.col("l_partkey") % 50).cast("double").alias("x1"), (F.col("l_suppkey") % 40).cast("double").alias("y1"), F.col("l_quantity").alias("x2"), (F.col("l_suppkey") % 40 - F.col("l_linenumber") * 3).cast("double").alias("y2"))
    r = r.unionByName(line).filter("ord < 2000")
    r = r.selectExpr("file_id", "ord", "least(x1, x2) a", "greatest(x1, x2) b", "least(y1, y2) c", "greatest(y1, y2) d")
    p, q = r.alias("p"), r.alias("q")
    hit = p.join(q, F.expr("p.file_id = q.file_id AND p.ord < q.ord AND p.a < q.b AND q.a < p.b AND p.c < q.d AND q.c < p.d"))
    return hit.groupBy("p.file_id").agg(F.count(F.lit(1)).alias("overlapping_pairs"))


NEEDED = ((1, "needed", "libc.so.6"), (1, "needed", "/opt/x/liby.so"), (1, "needed", "../z.so"), (1, "runpath", "$ORIGIN/../lib"), (2, "needed", "ld-linux-x86-64.so.2"), (3, "rpath", "/usr/lib"))


@query(
    f"""SELECT file_id, count(*) FILTER (view = 'needed') AS dependencies, count(*) FILTER (view = 'needed' AND name LIKE '/%') AS abs_path_count, count(*) FILTER (view = 'needed' AND contains(name, '../')) AS traversal_count,
  bool_or(view = 'needed' AND regexp_matches(name, '^ld-')) AS has_direct_loader_dep, bool_or(view IN ('runpath', 'rpath') AND contains(name, '$ORIGIN')) AS runpath_uses_origin FROM {lines_sql("file_id, view, name", *NEEDED)} GROUP BY file_id"""
)
def anm_dependencies(spark, sf_dir):
    """ANM-8: predicates over needed libraries and search paths."""
    n, needed = F.col("name"), F.col("view") == "needed"
    return lines(spark, sf_dir, "file_id long, view string, name string", *NEEDED).groupBy("file_id").agg(
        F.count_if(needed).alias("dependencies"),
        F.count_if(needed & n.startswith("/")).alias("abs_path_count"),
        F.count_if(needed & n.contains("../")).alias("traversal_count"),
        F.bool_or(needed & n.startswith("ld-")).alias("has_direct_loader_dep"),
        F.bool_or(F.col("view").isin("runpath", "rpath") & n.contains("$ORIGIN")).alias("runpath_uses_origin"),
    )


SPANS = ((1, 0, 4), (1, 4, 2), (1, 10, 1), (1, 11, 3), (1, 20, 0), (2, 5, 5))


@query(
    f"""WITH s AS (SELECT file_id, off, n FROM {values("file_id, off, n", *SPANS)} WHERE n > 0 UNION ALL SELECT DISTINCT 1000 + o_custkey, epoch(o_orderdate)::BIGINT // 864000 * 10, 10 FROM orders), g AS (SELECT *, sum(CASE WHEN off = prior THEN 0 ELSE 1 END) OVER (PARTITION BY file_id ORDER BY off) AS run FROM (SELECT *, lag(off + n) OVER (PARTITION BY file_id ORDER BY off) AS prior FROM s))
SELECT file_id, min(off) AS start, sum(n)::BIGINT AS len FROM g GROUP BY file_id, run"""
)
def rel_coalesced_spans(spark, sf_dir):
    """D7: empty spans go, and those that touch become one."""
    from faktum.operators.located import runs

    days = table(spark, sf_dir, "orders").select((1000 + F.col("o_custkey")).alias("file_id"), (F.floor(F.unix_timestamp("o_orderdate") / 864_000) * 10).alias("off"), F.lit(10).cast("long").alias("n")).distinct()
    found = runs(rows(spark, "file_id long, off long, n long", *SPANS).unionByName(days), ["file_id"], "off", "n")
    return found.select("file_id", F.col("offset").alias("start"), "len")


@query("""SELECT e.user_id, event_type AS kind, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS days FROM events e GROUP BY ALL""")
def view_kind_counts(spark, sf_dir):
    """VIEW: counts by kind, only of kinds that are there."""
    return table(spark, sf_dir, "events").groupBy("user_id", F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.date_trunc("day", "ts")).alias("days"))


@query("""SELECT event_id, json_keys(props)[1] AS first_key, json_extract_string(props, '$.' || json_keys(props)[1]) AS first_value FROM events""")
def jsn_navigation(spark, sf_dir):
    """JSN-11: a value at a path that the row itself names."""
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.json_object_keys("props")[0].alias("first_key"), F.try_element_at(m, F.json_object_keys("props")[0]).alias("first_value"))


@query("""SELECT conv_id, turn, role, strlen(text) AS n_bytes, strlen(text) - lag(strlen(text)) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS change, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS INTEGER) AS place FROM conversations""")
def rel_turn_windows(spark, sf_dir):
    """REL-W1: ranking and lag over the turns of a conversation."""
    w = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    n = F.octet_length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("n_bytes"), (n - F.lag(n).over(w)).alias("change"), F.row_number().over(w).alias("place"))


@query("""SELECT user_id, window_start, count(*) AS releases FROM (SELECT user_id, date_trunc('day', ts) AS window_start FROM events) GROUP BY ALL""")
def str_daily_windows(spark, sf_dir):
    """Releases in windows of a day; the same expression runs over a stream."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", F.window("ts", "1 day")).agg(F.count(F.lit(1)).alias("releases")).select("user_id", F.col("window.start").alias("window_start"), "releases")


# sinks, grouping, layouts and odd files


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars}) AS json FROM documents")
def snk_json(spark, sf_dir):
    """SNK-1: rows as JSON documents."""
    from faktum.plans.views import json_documents

    return json_documents(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@query(
    """WITH m AS (SELECT doc_id AS file_id, unnest(['file.size_bytes', 'text.total_lines', 'text.space_count', 'plain']) AS key, unnest([strlen(text), len(string_split(text, chr(10))), len(regexp_extract_all(text, ' ')), 1]) AS value FROM documents)
SELECT file_id, CASE WHEN contains(key, '.') THEN split_part(key, '.', 1) ELSE '' END AS namespace, CASE WHEN contains(key, '.') THEN regexp_replace(key, '^[^.]*\\.', '') ELSE key END AS name, CAST(value AS DOUBLE) AS value FROM m WHERE value > 0"""
)
def snk_metric_groups(spark, sf_dir):
    """SNK-3: metrics by the namespace in their keys."""
    from faktum.plans.views import by_namespace

    own = {"file.size_bytes": F.octet_length("text"), "text.total_lines": F.size(F.split("text", "\n", -1)), "text.space_count": F.regexp_count("text", F.lit(" ")), "plain": F.lit(1)}
    facts = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in own.items()))
    long = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.inline(facts)).filter("value > 0")
    return by_namespace(long)


def _zip_cases() -> tuple:
    import io
    import zipfile

    def made(comment=b"", wide=False):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            with z.open(zipfile.ZipInfo("a.txt", (2020, 1, 1, 0, 0, 0)), "w", force_zip64=wide) as f:
                f.write(b"hello")
            z.comment = comment
        return out.getvalue()

    return ("plain", made()), ("note", made(b"five!")), ("front", b"0123456789" + made()), ("back", made(b"xy") + b"tail...")


@query("SELECT * FROM " + values("file_id, comment_size, has_comment, uses_zip64, prefix_bytes, trailing_bytes", ("plain", 0, 0, 0, 0, 0), ("note", 5, 1, 0, 0, 0), ("front", 0, 0, 0, 10, 0), ("back", 2, 1, 0, 0, 7)))
def arc_zip_layout(spark, sf_dir):
    """ARC-1, 30, 31, 45 and 46."""
    from faktum.sources.containers import zip_layout

    return rows(spark, "file_id string, content binary", *_zip_cases()).select("file_id", zip_layout(F.col("content")).alias("z")).select("file_id", *(F.col(f"z.{x}").cast("int").alias(x) for x in ("comment_size", "has_comment", "uses_zip64", "prefix_bytes", "trailing_bytes")))


LINKS = ((1, "symlink", "/etc/passwd"), (1, "symlink", "a/../b"), (1, "symlink", "a..b/c"), (1, "file", "/x"), (2, "symlink", ".."), (2, "hardlink", "../x"), (2, "symlink", None), (3, "file", None))


@query(f"SELECT file_id, count(*) FILTER (entry_type = 'symlink' AND (linkname LIKE '/%' OR list_contains(string_split(linkname, '/'), '..'))) AS symlink_escape_count FROM {lines_sql('file_id, entry_type, linkname', *LINKS)} GROUP BY file_id")
def arc_symlink_escapes(spark, sf_dir):
    """ARC-19, of tars."""
    from faktum.operators.archive import symlink_escapes

    return symlink_escapes(lines(spark, sf_dir, "file_id int, entry_type string, linkname string", *LINKS))


_CLSID = bytes.fromhex("0114020000000000C000000000000046")
_PE = b"MZ" + bytes(58) + (64).to_bytes(4, "little") + b"PE\0\0rest"
ODD_FILES = (
    ("link", b"L\0\0\0" + _CLSID + b"more", "lnk"), ("near", b"L\0\0\0" + _CLSID[:-1] + b"\x47more", None), ("short", b"L\0\0\0", None), ("front", b"\x01" * 7 + _PE, "pe"), ("late", b"\x01" * 62 + _PE, "pe"), ("later", b"\x01" * 63 + _PE, None),
    ("unsigned", b"\x01" * 7 + _PE.replace(b"PE\0\0", b"PF\0\0"), None), ("second", b"\x01MZ\x01" + _PE, "pe"), ("cut", b"\x01" + _PE[:66], None),
)


@query("SELECT * FROM " + values("path, type", *((p, t) for p, _, t in ODD_FILES)))
def id_shifted_and_near(spark, sf_dir):
    """ID-1's shell links with near misses, and ID-12."""
    from faktum.operators.identify import magic

    return rows(spark, "path string, content binary", *((p, c) for p, c, _ in ODD_FILES)).select("path", magic(F.col("path"), F.col("content")).alias("type"))


LOADED = (
    (1, 0, ".text", 512, 600, ["write", "execinstr"]), (1, 1, ".data", 512, 2049, ["write"]), (1, 2, ".data", 512, 2048, ["write"]), (1, 3, ".bss", 0, 9000, ["write"]), (2, 0, ".rodata", 10, 41, []), (2, 1, ".debug_info", 10, 10, []), (2, 2, ".debug_line", 10, 0, []), (2, 3, ".rodata", 10, 40, ["write"]),
    (2, 4, ".hash", 8, 8, []), (3, 0, ".hash", 8, 8, ["alloc"]), (3, 1, ".gnu.hash", 8, 8, ["alloc"]), (3, 2, ".debug_str", 8, 8, ["compressed"]), (3, 3, ".debug_str", 8, 8, ["compressed"]), (3, 4, ".note", 8, 8, None),
)
_LOADED = lines_sql("file_id, ord, name, file_size, virtual_size, flags", *LOADED)
_LOADED_DDL = "file_id int, ord int, name string, file_size int, virtual_size int, flags array<string>"


@query(f"SELECT file_id, ord, name FROM {_LOADED} WHERE file_size <> 0 AND virtual_size > 4 * file_size")
def anm_inflated_sections(spark, sf_dir):
    """ANM-13."""
    from faktum.operators.sections import inflated

    return inflated(lines(spark, sf_dir, _LOADED_DDL, *LOADED)).select("file_id", "ord", "name")


@query(
    f"""WITH n AS (SELECT file_id, name, count(*) AS n, coalesce(bool_or(list_contains(flags, 'write')), false) AS w, count(*) FILTER (list_contains(flags, 'compressed')) AS c FROM {_LOADED} GROUP BY ALL)
SELECT file_id, count(*) FILTER (n > 1) AS duplicate_section_name_count, bool_or(name = '.text' AND w) AS text_section_writable, bool_or(name = '.rodata' AND w) AS rodata_writable, count(*) FILTER (starts_with(name, '.debug')) AS debug_name_count, sum(c)::BIGINT AS compressed_sections_count, bool_or(name = '.hash') AND bool_or(name = '.gnu.hash') AS has_both_hash_tables FROM n GROUP BY file_id"""
)
def anm_section_table(spark, sf_dir):
    """ANM-6: duplicate names, writable code and constants, debug and compressed sections, hash tables."""
    from faktum.operators.sections import table_anomalies

    return table_anomalies(lines(spark, sf_dir, _LOADED_DDL, *LOADED))
