"""Queries of text and byte metrics and of the string classifiers."""

from __future__ import annotations

from pyspark.sql import functions as F

from faktum.functions import bytes as B
from faktum.functions import strings as S
from faktum.functions import text as T
from faktum.registry import literal, query, rows, spread, table, values

SPACES = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

SAMPLES = (
    "", "plain", "a\n\nb\r\n", "\tx\n  y\n", "trail \nno\n x  \t y", "=" * 30 + "\n####////____++++ ||||**** ----", "x" * 120 + " " + "y" * 10, "aaaaaaaaaa bbbbbbbbbbbb",
    r"\x41\x4g \u0041 \u12 \U0001F600 \7\8 \\x41", r"end\u", r"\U1234567", "\u200bhid\u200dden\ufeff", "\ufeffbom", "nb\u00a0sp\u3000wide\u2003", "tab\t\ttab", "12 ab 3", "l" * 250 + "\n" + "m" * 600 + "\n" + "n" * 1100, "\x01\x7f\x1b", "one two three words here", "é" * 12,
    "  \n\t\n", "x\n" * 3 + "y",
)

_FIXTURE = values("id, text", *((i, s) for i, s in enumerate(SAMPLES)))


def _rounded(columns: dict) -> list:
    return [F.round(c, 6).alias(k) for k, c in columns.items()]


def _texts(spark, sf_dir):
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return docs.unionByName(rows(spark, "id long, text string", *((-1 - i, s) for i, s in enumerate(SAMPLES))))


_TEXTS = f"(SELECT doc_id AS id, text FROM documents UNION ALL SELECT -1 - id, text FROM {_FIXTURE})"

_LINES = f"""
WITH d AS (SELECT id, text FROM {_TEXTS} WHERE text <> ''),
l AS (SELECT id, list_transform(string_split(CASE WHEN text LIKE '%' || chr(10) THEN text[:-2] ELSE text END, chr(10)), lambda x: regexp_replace(x, '\\r$', '')) AS ls FROM d),
m AS (SELECT id, ls, list_transform(ls, lambda x: strlen(x)) AS ns, list_filter(ls, lambda x: NOT regexp_full_match(x, '[{SPACES}]*')) AS filled,
      list_transform(ls, lambda x: regexp_replace(x, '^[{SPACES}]+|[{SPACES}]+$', '', 'g')) AS ts FROM l)
SELECT id, CAST(len(ls) AS DOUBLE) AS total_lines, round(list_avg(ns), 6) AS avg_line_length,
  CASE WHEN list_max(ns) > 0 THEN CAST(list_max(ns) AS DOUBLE) END AS max_line_length,
  round(CASE WHEN list_stddev_pop(ns) > 0 THEN list_stddev_pop(ns) END, 6) AS line_length_stddev,
  nullif(CAST(len(list_filter(ns, lambda x: x > 200)) AS DOUBLE), 0) AS lines_over_200,
  nullif(CAST(len(list_filter(ns, lambda x: x > 500)) AS DOUBLE), 0) AS lines_over_500,
  nullif(CAST(len(list_filter(ns, lambda x: x > 1000)) AS DOUBLE), 0) AS lines_over_1000,
  CAST(strlen(filled[-1]) AS DOUBLE) AS last_line_length,
  round(nullif((len(ls) - len(filled)) / len(ls), 0), 6) AS empty_line_ratio,
  CASE WHEN len(list_filter(ls, lambda x: regexp_matches(x, '^ *\\t'))) > 0 AND len(list_filter(ls, lambda x: regexp_matches(x, '^\\t* '))) > 0 THEN 1.0::DOUBLE END AS mixed_indent,
  nullif(CAST(len(list_filter(ls, lambda x: regexp_matches(x, '[{SPACES}]$'))) AS DOUBLE), 0) AS trailing_whitespace_lines,
  CAST(list_max(list_transform(flatten(list_transform(ls, lambda x: regexp_extract_all(regexp_replace(x, '^[{SPACES}]+', ''), '([ \\t]+)[^ \\t]', 1))), lambda x: length(x))) AS DOUBLE) AS max_inline_whitespace_run,
  nullif(CAST(len(list_filter(ts, lambda x: strlen(x) >= 20 AND length(regexp_replace(x, '[^=\\-*#+|/\\\\_.]', '', 'g')) * 10 > strlen(x) * 7)) AS DOUBLE), 0) AS ascii_art_lines
FROM m
"""


@query(_LINES)
def txt_line_metrics(spark, sf_dir):
    facts = _texts(spark, sf_dir).filter("text <> ''").select("id", T.line_facts(F.col("text")).alias("l"))
    return facts.select("id", *_rounded({k: F.col(f"l.{k}") for k in facts.schema["l"].dataType.names}))


_CHARS = f"""
WITH d AS (SELECT id, text, strlen(text) AS n, len(regexp_extract_all(text, '[0-9]')) AS digits, len(regexp_extract_all(text, '[A-Za-z]')) AS letters FROM {_TEXTS} WHERE text <> ''),
r AS (SELECT id, count(*) AS runs FROM (SELECT id, g, count(*) AS k FROM (SELECT id, i, sum(CASE WHEN c = p THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY i) AS g
  FROM (SELECT id, i, c, lag(c) OVER (PARTITION BY id ORDER BY i) AS p FROM (SELECT id, unnest(string_split(text, '')) AS c, unnest(range(1, length(text) + 1)) AS i FROM d))) GROUP BY id, g) WHERE k >= 10 GROUP BY id)
SELECT d.id, round(nullif(len(regexp_extract_all(text, '[{SPACES}]')) / n, 0), 6) AS whitespace_ratio,
  nullif(CAST(len(regexp_extract_all(text, '\\t')) AS DOUBLE), 0) AS tab_count, nullif(CAST(len(regexp_extract_all(text, ' ')) AS DOUBLE), 0) AS space_count,
  nullif(CAST(len(regexp_extract_all(text, '[\\x{{a0}}\\x{{2000}}-\\x{{200a}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')) AS DOUBLE), 0) AS unusual_whitespace,
  nullif(CAST(len(regexp_extract_all(text, '[\\x{{fe00}}-\\x{{fe0f}}\\x{{200b}}-\\x{{200d}}\\x{{2060}}\\x{{feff}}\\x{{e0100}}-\\x{{e01ef}}\\x{{e0001}}-\\x{{e007f}}]')) - CASE WHEN starts_with(text, chr(65279)) THEN 1 ELSE 0 END AS DOUBLE), 0) AS invisible_chars,
  nullif(CAST(len(list_filter(regexp_split_to_array(text, '[{SPACES}]+'), lambda x: strlen(x) > 100)) AS DOUBLE), 0) AS long_token_count,
  CAST(runs AS DOUBLE) AS repeated_char_sequences,
  round(CASE WHEN digits > 0 THEN digits / (digits + letters) END, 6) AS digit_ratio
FROM d LEFT JOIN r ON d.id = r.id
"""


@query(_CHARS)
def txt_char_metrics(spark, sf_dir):
    return _texts(spark, sf_dir).filter("text <> ''").select("id", *_rounded(T.char_metrics(F.col("text"))))


_ESCAPES = rf"""
WITH d AS (SELECT id, text, strlen(text) AS n, len(regexp_extract_all(text, '\\x[0-9a-fA-F]{{2}}')) AS h,
  len(regexp_extract_all(text, '\\u')) - len(regexp_extract_all(right(text, 5), '\\u')) + len(regexp_extract_all(text, '\\U')) - len(regexp_extract_all(right(text, 9), '\\U')) AS u,
  len(regexp_extract_all(text, '\\[0-7]')) AS o FROM {_TEXTS} WHERE text <> '')
SELECT id, nullif(h::DOUBLE, 0) AS hex_escape_count, nullif(u::DOUBLE, 0) AS unicode_escape_count, nullif(o::DOUBLE, 0) AS octal_escape_count, round(nullif((h + u + o) * 100.0::DOUBLE / n, 0), 6) AS escape_density FROM d
"""


@query(_ESCAPES)
def txt_escape_metrics(spark, sf_dir):
    return _texts(spark, sf_dir).filter("text <> ''").select("id", *_rounded(T.escape_metrics(F.col("text"))))


_BYTES = f"""
WITH d AS (SELECT id, text, strlen(text) AS n FROM {_TEXTS} WHERE text <> ''),
b AS (SELECT id, n, x, count(*) AS k FROM (SELECT id, n, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM d) GROUP BY ALL),
v AS (SELECT id, n, k, CAST('0x' || x AS INTEGER) AS x FROM b)
SELECT id, round(-sum((k / n) * log2(k / n)) + 0.0, 6) AS char_entropy, CAST(count(*) AS DOUBLE) AS unique_chars,
  CAST(max_by(x, k * 256 + x) FILTER (x NOT IN (9, 10, 13, 32)) AS DOUBLE) AS most_common_char_codepoint,
  CAST(max_by(x, k * 256 + x) FILTER (x NOT IN (9, 10, 13, 32)) = 0 AS DOUBLE) AS most_common_char_is_null,
  round(max(k) FILTER (x NOT IN (9, 10, 13, 32)) / any_value(n), 6) AS most_common_ratio,
  round(nullif(coalesce(sum(k) FILTER (x > 127), 0) / any_value(n), 0), 6) AS non_ascii_ratio,
  round(nullif(coalesce(sum(k) FILTER ((x < 32 AND x NOT IN (9, 10, 13)) OR x = 127), 0) / any_value(n), 0), 6) AS non_printable_ratio,
  nullif(CAST(coalesce(sum(k) FILTER (x = 0), 0) AS DOUBLE), 0) AS null_byte_count,
  round(nullif(coalesce(sum(k) FILTER (x > 127), 0) / any_value(n), 0), 6) AS high_byte_ratio
FROM v GROUP BY id
"""


@query(_BYTES)
def txt_byte_metrics(spark, sf_dir):
    return _texts(spark, sf_dir).filter("text <> ''").select("id", *_rounded(T.byte_metrics(F.col("text"))))


@query(
    """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents)
SELECT doc_id, x AS byte_hex, count(*) AS n FROM b GROUP BY ALL"""
)
def byt_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(B.byte_counts(F.encode("text", "UTF-8"))))


_WINDOWS = """
WITH b AS (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM (SELECT doc_id, text, strlen(text) AS n FROM documents WHERE text <> '')),
h AS (SELECT doc_id, n, i // 1024 AS w, x, count(*) AS k FROM b GROUP BY ALL),
e AS (SELECT doc_id, n, w, least(1024, n - w * 1024) AS size, -sum((k / least(1024, n - w * 1024)) * log2(k / least(1024, n - w * 1024))) + 0.0 AS e FROM h GROUP BY ALL),
p AS (SELECT *, max(e) OVER (PARTITION BY doc_id) AS peak FROM e),
f AS (SELECT *, w - row_number() OVER (PARTITION BY doc_id ORDER BY w) AS g FROM p WHERE round(e, 9) >= round(peak - 0.5, 9)),
r AS (SELECT doc_id, any_value(peak) AS peak, min(w) * 1024 AS off, sum(size) AS len FROM f GROUP BY doc_id, g),
a AS (SELECT doc_id, -sum((k / n) * log2(k / n)) + 0.0 AS overall FROM (SELECT doc_id, n, x, sum(k) AS k FROM h GROUP BY ALL) GROUP BY doc_id)
SELECT r.doc_id, round(any_value(overall), 6) AS overall_entropy, round(any_value(peak), 6) AS peak_region_entropy, CAST(sum(len) AS BIGINT) AS peak_region_bytes, CAST(min_by(off, -len * 1e9 + off) AS BIGINT) AS peak_offset
FROM r JOIN a ON r.doc_id = a.doc_id GROUP BY r.doc_id
"""


@query(_WINDOWS)
def byt_windowed_entropy(spark, sf_dir):
    facts = B.window_facts(F.encode("text", "UTF-8"))
    rows_ = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", facts.alias("w"))
    return rows_.select("doc_id", F.round("w.overall", 6).alias("overall_entropy"), F.round("w.peak", 6).alias("peak_region_entropy"), F.col("w.peak_bytes").alias("peak_region_bytes"), F.col("w.peak_offset").alias("peak_offset"))


@query(
    rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[{SPACES}]+'), lambda x: x <> '') AS ts FROM l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (strlen(line) >= 12 AND len(regexp_extract_all(line, ' ')) >= 2 AND len(ts) >= 3 AND len(list_filter(ts, lambda x: len(regexp_extract_all(x, '\pL')) >= 2)) >= 2) AS n_sentences FROM t GROUP BY doc_id"""
)
def byt_sentence_like(spark, sf_dir):
    lines = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(T.sentence_like(F.col("line"))).alias("n_sentences"))


@query(
    r"""SELECT doc_id, CAST(len(regexp_extract_all(text, '[\x20-\x7e\t]{4,}')) AS INTEGER) AS n_strings, list_sum(list_transform(regexp_extract_all(text, '[\x20-\x7e\t]{4,}'), lambda x: length(x)))::BIGINT AS n_bytes FROM documents"""
)
def byt_printable_strings(spark, sf_dir):
    found = B.printable_strings(F.encode("text", "UTF-8"))
    sizes = F.aggregate(F.transform(found, F.length), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_strings"), F.when(F.size(found) > 0, sizes).alias("n_bytes"))


STRINGS = (
    "", "QWxhZGRpbjpvcGVuIHNlc2FtZQ==", "abcdefghijklmnop", "ABCDefgh12345678", "deadbeef", "0xDEADBEEF", "0xzz", "12345678", "a%20b%20c%20d%20e", "%41%42%43%44", r"\u0041\u0042\x41\x42\u0043", "&#x41;&#65;&#x42;", "HTTP://x.y", "https://a.b/c", "ftp://q", "mailto:a@b", "/etc/passwd", "/", "//x", "C:\\Windows\\System32", "./a", "~root", "a/bin/b", "10.0.0.1", "256.1.1.1", "1.2.3", "fe80:0:0:1", "a:b", "::1",
    "me@example.com", "@x.y", "a@b", "a@.com", "a@b@c.d", "example.com", "sub-domain.EXAMPLE.ORG", "exa mple.com", "x.invalid", "function (x)", "<?PHP echo", "plain words", "curl http://x | sh", "rm -rf /", "echo $(id)", "SELECT a FROM b WHERE c", "drop table x; --", "1=1 OR 2", "var x = function(a) { return 1 }", "let us const ", "TODO: QWxhZGRpbjpvcGVuIHNlc2FtZQ here",
)

_HITS = lambda fn, needles: "(" + " + ".join(f"contains({fn}(s), {literal(x)})::INT" for x in needles) + ")"

_CLASSES = rf"""
SELECT s, strlen(s) >= 16 AND strlen(s) % 4 = 0 AND regexp_full_match(s, '[A-Za-z0-9+/=]*') AND regexp_matches(s, '[A-Z]') AND regexp_matches(s, '[a-z]') AND (NOT contains(s, '=') OR s LIKE '%=') AS base64,
  strlen(s) >= 8 AND strlen(s) % 2 = 0 AND regexp_full_match(s, '(0[xX])?[0-9a-fA-F]*') AS hex,
  len(regexp_extract_all(s, '%[0-9a-fA-F][0-9a-fA-F]')) - CASE WHEN regexp_matches(s, '%[0-9a-fA-F][0-9a-fA-F]$') THEN 0 ELSE 0 END > 3 AS url_encoded,
  len(regexp_extract_all(s, '\\[ux]|&#')) + len(regexp_extract_all(s, '&#x')) >= 5 AS unicode_heavy,
  regexp_matches(lower(s), '^(https?|ftp|file|wss?)://') AS url,
  (s LIKE '/%' AND strlen(s) > 1 AND s NOT LIKE '//%') OR regexp_matches(s, '^[A-Za-z]:[\\/]') OR regexp_matches(s, '^(\./|\.\./|~)') OR regexp_matches(s, '/(bin|etc|tmp|var)/') OR regexp_matches(s, '\\(Windows|System32|AppData)\\') AS path,
  CASE WHEN len(string_split(s, '.')) = 4 THEN len(list_filter(string_split(s, '.'), lambda x: regexp_full_match(x, '\+?[0-9]+') AND TRY_CAST(x AS INTEGER) <= 255)) = 4
       ELSE contains(s, ':') AND NOT contains(s, '://') AND len(regexp_extract_all(s, ':')) BETWEEN 2 AND 7 AND regexp_full_match(s, '[0-9a-fA-F:]*') END AS ip,
  strlen(s) >= 5 AND len(string_split(s, '@')) = 2 AND split_part(s, '@', 1) <> '' AND contains(split_part(s, '@', 2), '.') AND split_part(s, '@', 2) NOT LIKE '.%' AND split_part(s, '@', 2) NOT LIKE '%.' AS email,
  contains(s, '.') AND regexp_full_match(s, '[A-Za-z0-9.\-]*') AND regexp_matches(lower(s), '\.(com|net|org|io|dev|co|xyz|ru|cn|de|uk|info|biz|cc|top|online|site|tk|ml|ga)$') AS domain,
  {_HITS("lower", S.EMBEDDED_CODE)} > 0 AS embedded_code, {_HITS("lower", S.SHELL)} > 0 AS shell, {_HITS("upper", S.SQL)} >= 2 AS sql, {_HITS("lower", S.COMMENT_CODE)} >= 2 AS comment_code,
  len(list_filter(regexp_split_to_array(s, '[{SPACES}]+'), lambda x: strlen(x) >= 20 AND len(regexp_extract_all(x, '[A-Za-z0-9+/=]')) * 10 > strlen(x) * 9 AND regexp_matches(x, '[A-Z]') AND regexp_matches(x, '[a-z]'))) > 0 AS comment_base64
FROM (SELECT DISTINCT s FROM (SELECT unnest(string_split(text, ' ')) AS s FROM documents UNION ALL SELECT s FROM {values("s", *((x,) for x in STRINGS))}))
"""


@query(_CLASSES)
def lit_classifiers(spark, sf_dir):
    words = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(F.split("text", " ", -1)).alias("s"))
    s = F.col("s")
    tests = {
        "base64": S.is_likely_base64, "hex": S.is_hex_string, "url_encoded": S.has_url_encoding, "unicode_heavy": S.has_unicode_heavy, "url": S.is_url, "path": S.is_file_path, "ip": S.is_ip_address,
        "email": S.is_email, "domain": S.is_domain, "embedded_code": S.has_embedded_code, "shell": S.has_shell_command, "sql": S.has_sql_pattern, "comment_code": S.has_code_patterns, "comment_base64": S.has_base64_pattern,
    }
    return words.unionByName(rows(spark, "s string", *((x,) for x in STRINGS))).distinct().select("s", *(f(s).alias(k) for k, f in tests.items()))


_LITERALS = rf"""
WITH s AS (SELECT p_partkey AS file_id, unnest(string_split(p_name || '  ' || p_brand || ' ' || p_type, ' ')) AS s FROM part UNION ALL SELECT -1, s FROM {values("s", *((x,) for x in STRINGS))} UNION ALL SELECT -2, repeat(chr(97 + (i % 26)::INT) || i || 'Qz', 40) FROM range(30) AS r(i)),
e AS (SELECT s, -sum((k / n) * log2(k / n)) + 0.0 AS e FROM (SELECT s, strlen(s) AS n, x, count(*) AS k FROM (SELECT s, unnest(regexp_extract_all(hex(encode(s)), '..')) AS x FROM (SELECT DISTINCT s FROM s)) GROUP BY ALL) GROUP BY s),
c AS ({_CLASSES.replace("SELECT unnest(string_split(text, ' ')) AS s FROM documents UNION ALL", "SELECT DISTINCT s FROM s UNION ALL")})
SELECT file_id, count(*) AS total, sum(strlen(s.s))::BIGINT AS total_bytes, round(avg(strlen(s.s)), 6) AS avg_length, max(strlen(s.s)) AS max_length, count(*) FILTER (s.s = '') AS empty_count, round(avg(e) FILTER (s.s <> ''), 6) AS avg_entropy,
  round(stddev_pop(e) FILTER (s.s <> ''), 6) AS entropy_stddev, count(*) FILTER (round(e, 9) > 5.0) AS high_entropy_count, count(*) FILTER (round(e, 9) > 6.5) AS very_high_entropy_count, count(*) FILTER (strlen(s.s) > 1000) AS very_long_strings,
  count(*) FILTER (base64) AS base64_candidates, count(*) FILTER (hex) AS hex_strings, count(*) FILTER (url_encoded) AS url_encoded_strings, count(*) FILTER (unicode_heavy) AS unicode_heavy_strings, count(*) FILTER (url) AS url_count, count(*) FILTER (path) AS path_count,
  count(*) FILTER (ip) AS ip_count, count(*) FILTER (email) AS email_count, count(*) FILTER (domain) AS domain_count, count(*) FILTER (embedded_code) AS embedded_code_candidates, count(*) FILTER (shell) AS shell_command_strings, count(*) FILTER (sql) AS sql_strings
FROM s LEFT JOIN e ON s.s = e.s JOIN c ON s.s = c.s GROUP BY file_id
"""


@query(_LITERALS)
def lit_metrics(spark, sf_dir):
    """The counts of a file's string literals."""
    from faktum.operators.names import literal_metrics

    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.explode(F.split(F.concat(F.col("p_name"), F.lit("  "), F.col("p_brand"), F.lit(" "), F.col("p_type")), " ", -1)).alias("value"))
    odd = rows(spark, "value string", *((x,) for x in STRINGS)).select(F.lit(-1).cast("long").alias("file_id"), "value")
    long_ = spark.range(30).select(F.lit(-2).cast("long").alias("file_id"), F.expr("repeat(concat(chr(97 + id % 26), id, 'Qz'), 40)").alias("value"))
    return literal_metrics(words.unionByName(odd).unionByName(long_))


TARGETS = ("ls", "/usr/bin/x", "$CC", "${VAR}", "b$@u", "$A$B", "b${X}u${Y}n", "python${VER}", "\\b\\u\\n", "\\rm", "$(command -v python)", "$(echo bun)", "$(printf '\\x62')", "$(echo \"$x\" | sed s/a/b/)", "`id`", "\"$VAR\"", "eval a b", "$(base64 -d)")

_TARGETS = rf"""
WITH t AS (SELECT t, regexp_replace(t, '["'']', '', 'g') AS s FROM (SELECT * FROM {values("t", *((x,) for x in TARGETS))} UNION ALL SELECT {literal(TARGETS)}[1 + p_partkey % {len(TARGETS)}] || ' ' || p_name || ' ' || p_partkey FROM part UNION ALL SELECT {literal(TARGETS)}[1 + p_partkey % {len(TARGETS)}] || p_partkey FROM part))
SELECT t, CASE WHEN contains(t, '/') THEN 'clean'
  WHEN contains(s, '$(') OR contains(s, '`') THEN CASE WHEN contains(s, 'base64') OR contains(s, 'xxd') OR (contains(s, 'printf') AND regexp_matches(s, '\\[xX0-7]')) OR (contains(s, 'echo') AND NOT contains(s, '|')) THEN 'obfuscated' ELSE 'dynamic' END
  WHEN regexp_matches(s, '[ \t\n\r]') THEN 'clean'
  WHEN len(regexp_extract_all(s, '\\')) >= 2 OR (regexp_matches(s, '[A-Za-z0-9]\$') AND (len(regexp_extract_all(s, '\$')) >= 2 OR contains(s, '$@') OR contains(s, '$*'))) THEN 'obfuscated'
  WHEN s LIKE '$%' THEN 'dynamic' ELSE 'clean' END AS kind FROM t
"""


@query(_TARGETS)
def cal_target_kinds(spark, sf_dir):
    """Typed targets, and these before numbers and names of parts."""
    own = F.element_at(F.array(*map(F.lit, TARGETS)), (1 + F.col("p_partkey") % len(TARGETS)).cast("int"))
    parts = table(spark, sf_dir, "part")
    made = parts.select(F.concat(own, F.lit(" "), "p_name", F.lit(" "), "p_partkey").alias("t")).unionByName(parts.select(F.concat(own, "p_partkey").alias("t")))
    return rows(spark, "t string", *((x,) for x in TARGETS)).unionByName(made).select("t", S.call_target_kind(F.col("t")).alias("kind"))


@query(f"SELECT count(*) AS total, count(*) FILTER (kind = 'obfuscated') AS obfuscated_target_count, count(*) FILTER (kind = 'dynamic') AS dynamic_target_count FROM ({_TARGETS})")
def cal_metrics(spark, sf_dir):
    """CAL-1 and CAL-2 as counts of a file."""
    kinds = cal_target_kinds(spark, sf_dir)
    return kinds.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("kind") == "obfuscated").alias("obfuscated_target_count"), F.count_if(F.col("kind") == "dynamic").alias("dynamic_target_count"))


NAMES = ("x", "tmp1", "a1", "__init__", "_private", "CONST_A", "camelCase", "deadbeef", "qwerty_key", "aaa", "_", "Base64Name1", "var9", "Zürich", "i", "abc123def", "zzzz", "item7", "K9", "x10")

_NAMES_SQL = rf"""
WITH w AS (SELECT p_partkey AS file_id, unnest(string_split(p_name || ' ' || p_brand || ' ' || p_type, ' ')) AS s FROM part UNION ALL SELECT -1, s FROM {values("s", *((x,) for x in NAMES))}),
u AS (SELECT DISTINCT file_id, s FROM w WHERE s <> ''),
e AS (SELECT s, -sum((k / n) * log2(k / n)) + 0.0 AS e FROM (SELECT s, strlen(s) AS n, x, count(*) AS k FROM (SELECT s, unnest(regexp_extract_all(hex(encode(s)), '..')) AS x FROM (SELECT DISTINCT s FROM u)) GROUP BY ALL) GROUP BY s),
t AS (SELECT file_id, count(*) AS total FROM w WHERE s <> '' GROUP BY file_id)
SELECT u.file_id, CAST(any_value(total) AS DOUBLE) AS total, CAST(count(*) AS DOUBLE) AS unique_count, round(count(*) / any_value(total), 6) AS reuse_ratio, round(avg(strlen(u.s)), 6) AS avg_length,
  CAST(min(strlen(u.s)) AS DOUBLE) AS min_length, CAST(max(strlen(u.s)) AS DOUBLE) AS max_length, round(stddev_pop(strlen(u.s)), 6) AS length_stddev,
  CAST(count(*) FILTER (strlen(u.s) = 1) AS DOUBLE) AS single_char_count, round(count(*) FILTER (strlen(u.s) = 1) / count(*), 6) AS single_char_ratio, round(count(*) FILTER (regexp_full_match(u.s, '[a-z_]*')) / count(*), 6) AS all_lowercase_ratio,
  round(count(*) FILTER (regexp_full_match(u.s, '[A-Z_]*')) / count(*), 6) AS all_uppercase_ratio, round(count(*) FILTER (regexp_matches(u.s, '[0-9]')) / count(*), 6) AS has_digit_ratio,
  CAST(count(*) FILTER (u.s LIKE '\_%' ESCAPE '\') AS DOUBLE) AS underscore_prefix_count, CAST(count(*) FILTER (regexp_full_match(u.s, '__.+__')) AS DOUBLE) AS double_underscore_count,
  CAST(count(*) FILTER (regexp_full_match(u.s, '.*[A-Za-z].*[0-9]')) AS DOUBLE) AS numeric_suffix_count,
  CAST(count(*) FILTER (strlen(u.s) >= 6 AND strlen(u.s) % 2 = 0 AND len(regexp_extract_all(u.s, '[0-9a-fA-F]')) * 10 > strlen(u.s) * 9) AS DOUBLE) AS hex_like_names,
  CAST(count(*) FILTER (strlen(u.s) >= 8 AND len(regexp_extract_all(u.s, '[A-Za-z0-9+/=]')) * 20 > strlen(u.s) * 19 AND regexp_matches(u.s, '[A-Z]') AND regexp_matches(u.s, '[a-z]') AND regexp_matches(u.s, '[0-9]')) AS DOUBLE) AS base64_like_names,
  CAST(count(*) FILTER (regexp_full_match(u.s, '[A-Za-z][0-9]?|(?i:{"|".join(S.SEQUENCE_STEMS)})[0-9]')) AS DOUBLE) AS sequential_names,
  CAST(count(*) FILTER (regexp_matches(lower(u.s), '{"|".join(S.KEYBOARD)}')) AS DOUBLE) AS keyboard_pattern_names,
  CAST(count(*) FILTER (strlen(u.s) >= 3 AND replace(u.s, left(u.s, 1), '') = '') AS DOUBLE) AS repeated_char_names,
  round(avg(e), 6) AS avg_entropy, CAST(count(*) FILTER (round(e, 9) > 3.5) AS DOUBLE) AS high_entropy_count, round(count(*) FILTER (round(e, 9) > 3.5) / count(*), 6) AS high_entropy_ratio
FROM u JOIN e ON u.s = e.s JOIN t ON u.file_id = t.file_id GROUP BY u.file_id
"""


@query(_NAMES_SQL)
def idn_metrics(spark, sf_dir):
    from faktum.operators.names import identifier_metrics

    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_brand", "p_type"), " ")).alias("name"))
    words = words.unionByName(rows(spark, "name string", *((x,) for x in NAMES)).select(F.lit(-1).cast("long").alias("file_id"), "name"))
    return identifier_metrics(words)


#: Characters that show nothing, and a text without its leading byte order mark, which is none of them.
_HIDDEN = r"\x{fe00}-\x{fe0f}\x{200b}-\x{200d}\x{2060}\x{feff}\x{e0100}-\x{e01ef}\x{e0001}-\x{e007f}"
_SHOWN = "CASE WHEN starts_with(text, chr(65279)) THEN '\u20ac' || text[2:] ELSE text END"


def long_metrics_sql(files: str) -> str:
    """The long table of metrics of files: `files` gives (id, text)."""
    own = lambda sql: "(" + sql.replace(_TEXTS, "f") + ")"
    families = " UNION ALL ".join(f"SELECT id, 'text.' || key AS key, value, 0 AS n_spans, NULL AS first_offset FROM (UNPIVOT {own(x)} ON COLUMNS(* EXCLUDE id) INTO NAME key VALUE value)" for x in (_LINES, _CHARS, _ESCAPES, _BYTES))
    return f"""
WITH f AS MATERIALIZED ({files}),
b AS (SELECT id, n, unnest(range(0, n)) AS i, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM (SELECT id, text, strlen(text) AS n FROM f WHERE text <> '')),
h AS MATERIALIZED (SELECT id, n, i // 1024 AS w, x, count(*) AS k FROM b GROUP BY ALL),
e AS (SELECT id, n, w, least(1024, n - w * 1024) AS size, -sum((k / least(1024, n - w * 1024)) * log2(k / least(1024, n - w * 1024))) + 0.0 AS e FROM h GROUP BY ALL),
p AS (SELECT *, max(e) OVER (PARTITION BY id) AS peak FROM e),
g AS (SELECT *, w - row_number() OVER (PARTITION BY id ORDER BY w) AS g FROM p WHERE round(e, 9) >= round(peak - 0.5, 9)),
r AS (SELECT id, any_value(peak) AS peak, min(w) * 1024 AS off, sum(size) AS len FROM g GROUP BY id, g),
z AS (SELECT id, ls[i] AS l, list_sum(list_transform(ls[: i - 1], lambda x: strlen(x) + 1)) AS off FROM (SELECT id, ls, list_position(ns, list_max(ns)) AS i FROM (SELECT id, string_split(text, chr(10)) AS ls, list_transform(ls, lambda x: strlen(regexp_replace(x, '\\r$', ''))) AS ns FROM f))),
o AS (SELECT id, -sum((k / n) * log2(k / n)) + 0.0 AS overall FROM (SELECT id, n, x, sum(k) AS k FROM h GROUP BY ALL) GROUP BY id),
s AS (SELECT id, any_value(peak) AS peak, sum(len) AS bytes, least(64, count(*)) AS n_spans, min_by(off, -len * 1e9 + off) AS first_offset FROM r GROUP BY id),
a AS (SELECT f.id, strlen(text) AS size, coalesce(overall, 0) AS overall, coalesce(peak, 0) AS peak, coalesce(bytes, 0) AS bytes, coalesce(n_spans, 0) AS n_spans, first_offset FROM f LEFT JOIN o ON f.id = o.id LEFT JOIN s ON f.id = s.id),
m AS (SELECT id, 'file.size_bytes' AS key, size::DOUBLE AS value, 0 AS n_spans, NULL AS first_offset FROM a UNION ALL SELECT id, unnest(['file.entropy', 'binary.overall_entropy']), round(overall, 6), 0, NULL FROM a
  UNION ALL SELECT id, 'binary.peak_region_bytes', bytes::DOUBLE, 0, NULL FROM a UNION ALL SELECT id, 'binary.peak_region_entropy', round(peak, 6), n_spans, first_offset FROM a UNION ALL {families})
SELECT sha256(f.text) AS file_id, key, round(value, 6) AS value,
  CAST(CASE key WHEN 'text.max_line_length' THEN 1 WHEN 'text.invisible_chars' THEN least(64, len(regexp_extract_all({_SHOWN}, '[{_HIDDEN}]+'))) ELSE n_spans END AS INTEGER) AS n_spans,
  CAST(CASE key WHEN 'text.max_line_length' THEN coalesce(off, 0) WHEN 'text.invisible_chars' THEN strlen(regexp_extract({_SHOWN}, '^[^{_HIDDEN}]*')) ELSE first_offset END AS BIGINT) AS first_offset
FROM m JOIN f ON m.id = f.id JOIN z ON z.id = f.id WHERE value IS NOT NULL"""


_MARKED = "replace(replace(replace(text, '. ', '.\u200b\u2060 '), ', ', ',\ufeff '), 'th', 'th\r\n')"


@query(
    rf"""WITH t AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN chr(65279) || {_MARKED} ELSE {_MARKED} END AS text FROM documents WHERE text <> ''),
c AS (SELECT doc_id, regexp_split_to_array({_SHOWN}, '[{_HIDDEN}]+') AS p, regexp_extract_all({_SHOWN}, '[{_HIDDEN}]+') AS h FROM t),
s AS (SELECT doc_id, list_transform(range(1, len(h) + 1), lambda i: {{'o': CAST(list_sum(list_transform(p[1 : i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(h[1 : i - 1], lambda x: strlen(x))), 0) AS BIGINT), 'n': strlen(h[i])}}) AS s FROM c),
z AS (SELECT doc_id, i, ls, ns FROM (SELECT *, list_position(ns, list_max(ns)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, list_transform(string_split(text, chr(10)), lambda x: strlen(regexp_replace(x, '\r$', ''))) AS ns FROM t)))
SELECT doc_id, CAST(len(s) AS INTEGER) AS n_spans, s[1].o AS first_offset, s[-1].o AS last_offset, CAST(list_sum(list_transform(s, lambda x: x.n)) AS BIGINT) AS covered,
  CAST(coalesce(list_sum(list_transform(ls[: i - 1], lambda x: strlen(x) + 1)), 0) AS BIGINT) AS line_offset, CAST(ns[i] AS BIGINT) AS line_bytes FROM s JOIN z USING (doc_id)"""
)
def txt_located(spark, sf_dir):
    """TXT-12, TXT-27: where invisible characters and the longest line stand, in documents with such characters and line ends put in."""
    marked = F.replace(F.replace(F.replace("text", F.lit(". "), F.lit(".\u200b\u2060 ")), F.lit(", "), F.lit(",\ufeff ")), F.lit("th"), F.lit("th\r\n"))
    docs = spread(table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", "text"))
    docs = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\ufeff"), marked)).otherwise(marked).alias("text"))
    docs = docs.select("doc_id", T.all_invisible_spans(F.col("text")).alias("s"), F.get(T.longest_line_spans(F.col("text")), F.lit(0)).alias("l"))
    covered = F.aggregate("s", F.lit(0).cast("long"), lambda n, x: n + x["len"])
    return docs.select("doc_id", F.size("s").alias("n_spans"), F.get("s", F.lit(0))["offset"].alias("first_offset"), F.try_element_at("s", F.lit(-1))["offset"].alias("last_offset"), F.when(F.size("s") > 0, covered).alias("covered"), *(F.coalesce(f"l.{x}", F.lit(0).cast("long")).alias(y) for x, y in (("offset", "line_offset"), ("len", "line_bytes"))))


# contents in chunks: the documents of a source, one after the other

_CHUNKED = """b AS MATERIALIZED (SELECT source, doc_id, base, i, x, base + i AS pos FROM (SELECT source, doc_id, base, unnest(range(0, strlen(text))) AS i, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM (
  SELECT source, doc_id, text, coalesce(sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM documents)))"""


@query(
    f"""WITH {_CHUNKED},
h AS MATERIALIZED (SELECT source, pos // 1024 AS w, x, count(*) AS k FROM b GROUP BY ALL),
e AS (SELECT source, w, sum(k) AS size, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 9) + 0.0 AS e FROM h GROUP BY ALL),
g AS (SELECT *, w - row_number() OVER (PARTITION BY source ORDER BY w) AS g FROM (SELECT *, max(e) OVER (PARTITION BY source) AS peak FROM e) WHERE e >= round(peak - 0.5, 9)),
r AS (SELECT source, any_value(peak) AS peak, min(w) * 1024 AS off, sum(size) AS len, row_number() OVER (PARTITION BY source ORDER BY sum(size) DESC, min(w)) AS place FROM g GROUP BY source, g),
o AS (SELECT source, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS overall, sum(k) AS size FROM (SELECT source, x, sum(k) AS k FROM h GROUP BY ALL) GROUP BY source)
SELECT source, round(overall, 6) AS overall_entropy, CAST(size AS BIGINT) AS size_bytes, round(any_value(peak), 6) AS peak_region_entropy, CAST(sum(len) AS BIGINT) AS peak_region_bytes, count(*) AS n_runs,
  CAST(least(64, count(*)) AS INTEGER) AS n_spans, CAST(max(off) FILTER (place = 1) AS BIGINT) AS longest_offset, CAST(max(len) FILTER (place = 1) AS BIGINT) AS longest_bytes, CAST(max(off) FILTER (place = least(64, n)) AS BIGINT) AS last_offset
FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM r) JOIN o USING (source) GROUP BY source, overall, size"""
)
def byt_chunked_entropy(spark, sf_dir):
    """BYT-3, 4 over contents of many rows: windows, histograms and runs go over the borders of chunks."""
    from faktum.operators.located import peak_regions

    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("content")))
    found = peak_regions(docs, ["source"], "doc_id", "content")
    last = F.element_at("spans", F.lit(-1))["offset"]
    return found.select("source", F.round("overall", 6).alias("overall_entropy"), F.col("size").alias("size_bytes"), F.round("peak", 6).alias("peak_region_entropy"), F.col("covered").alias("peak_region_bytes"), "n_runs", F.size("spans").alias("n_spans"), F.col("spans")[0]["offset"].alias("longest_offset"), F.col("spans")[0]["len"].alias("longest_bytes"), last.alias("last_offset"))


@query(
    f"""WITH {_CHUNKED},
p AS (SELECT *, i - row_number() OVER (PARTITION BY source, doc_id ORDER BY i) AS g FROM b WHERE x BETWEEN '20' AND '7E' OR x = '09'),
c AS (SELECT source, doc_id, g, x, count(*) AS k, min(pos) AS pos FROM p GROUP BY ALL),
s AS (SELECT source, min(pos) AS off, sum(k) AS len, round(log2(sum(k)) - sum(k * log2(k)) / sum(k), 9) AS e FROM c GROUP BY source, doc_id, g HAVING sum(k) >= 4),
h AS (SELECT source, off, len, sum(CASE WHEN before = off THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY off) AS run FROM (SELECT *, lag(off + len) OVER (PARTITION BY source ORDER BY off) AS before FROM s WHERE e >= 4.2)),
r AS (SELECT source, run, min(off) AS off, sum(len) AS len, count(*) OVER (PARTITION BY source) AS n FROM h GROUP BY source, run),
q AS (SELECT source, any_value(n) AS n_runs, max(off) FILTER (run = least(64, n)) AS last_offset, min(off) AS first_offset, sum(len) FILTER (run <= 64) AS covered FROM r GROUP BY source)
SELECT s.source, count(*) AS string_count, CAST(max(len) AS BIGINT) AS max_string_length, CAST(arg_max(off, len * 1e12 - off) AS BIGINT) AS max_offset, count(*) FILTER (e >= 4.2) AS high_entropy_count,
  any_value(n_runs) AS n_runs, CAST(any_value(first_offset) AS BIGINT) AS first_offset, CAST(any_value(last_offset) AS BIGINT) AS last_offset, CAST(any_value(covered) AS BIGINT) AS covered FROM s LEFT JOIN q ON s.source = q.source GROUP BY s.source"""
)
def agg_located_strings(spark, sf_dir):
    """AGG-11, 14: the longest string and those of high entropy with their places, over contents of many rows (threshold as a parameter: prose has 4.2)."""
    from faktum.operators.located import string_facts

    docs = spread(table(spark, sf_dir, "documents").select("source", "doc_id", F.encode("text", "UTF-8").alias("content")))
    found = string_facts(docs, ["source"], "doc_id", "content", 4.2)
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["len"])
    return found.select("source", "string_count", "max_string_length", "max_offset", "high_entropy_count", "n_runs", F.get("spans", F.lit(0))["offset"].alias("first_offset"), F.try_element_at("spans", F.lit(-1))["offset"].alias("last_offset"), covered.alias("covered"))
