"""Comments of source text by one pass of an alternation, and their metrics.

String literals are matched first, so that comment marks inside them are
skipped.  An unterminated block comment reaches to the end, less one
character.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faktum.functions import strings as S
from faktum.functions.bytes import byte_entropy
from faktum.functions.text import line_count, trimmed

_STRINGS = r""""(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?"""
#: What begins and ends comments, by style; the body is the one group that isn't empty.
STYLES = {
    "c": rf"(?s){_STRINGS}|//([^\n]*)|/\*(.*?)\*/|/\*(.*).\z",
    "c_template": rf"(?s){_STRINGS}|`(?:\\.|[^`\\])*`?|//([^\n]*)|/\*(.*?)\*/|/\*(.*).\z",
    "hash": rf'(?s)"""(.*?)"""|\'\'\'(.*?)\'\'\'|{_STRINGS}|#([^\n]*)',
    "double_dash": rf"(?s){_STRINGS}|--([^\n]*)",
    "semicolon": rf'(?s)"(?:\\.|[^"\\])*"?|;([^\n]*)',
    "batch": r"(?im)^[ \t]*(?:rem(?=[ \t]|$)[ \t]?|::)([^\n]*)",
}
#: The style of each language.
LANGUAGES = {
    "c": "c java csharp go rust swift objective_c scala kotlin zig groovy php", "c_template": "javascript typescript", "hash": "python ruby perl shell powershell elixir makefile dockerfile",
    "double_dash": "lua applescript", "semicolon": "clojure", "batch": "batch",
}


def style_of(file_type: Column) -> Column:
    table = F.create_map(*(F.lit(y) for style, own in LANGUAGES.items() for x in own.split() for y in (x, style)))
    return F.try_element_at(table, file_type)


def bodies(text: Column, style: str) -> Column:
    """The comments' bodies in order."""
    whole = F.regexp_extract_all(text, F.lit(STYLES[style]), F.lit(0))

    def body(x: Column) -> Column:
        if style in ("c", "c_template"):
            closed = x.startswith("/*") & x.endswith("*/") & (F.length(x) >= 4)
            return F.when(x.startswith("//"), F.substr(x, F.lit(3))).when(closed, F.regexp_replace(x, r"(?s)\A/\*|\*/\z", "")).when(x.startswith("/*"), F.regexp_replace(x, r"(?s)\A/\*|.\z", ""))
        if style == "hash":
            return F.when(x.startswith("#"), F.substr(x, F.lit(2))).when(x.rlike(r"\A(?:\"\"\"|''')"), F.regexp_replace(x, r"\A(?:\"\"\"|''')|(?:\"\"\"|''')\z", ""))
        if style == "double_dash":
            return F.when(x.startswith("--"), F.substr(x, F.lit(3)))
        if style == "semicolon":
            return F.when(x.startswith(";"), F.substr(x, F.lit(2)))
        return F.regexp_extract(x, STYLES["batch"], 1)

    return F.filter(F.transform(whole, body), lambda x: x.isNotNull())


def comments(sources: DataFrame) -> DataFrame:
    """sources: (file_id, file_type, text) to (file_id, ord, body)."""
    own = F.lit(None).cast("array<string>")
    for style in STYLES:
        own = F.when(style_of(F.col("file_type")) == style, bodies(F.col("text"), style)).otherwise(own)
    return sources.select("file_id", F.posexplode(own).alias("ord", "body"))


def metrics(found: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Counts over each file's comments; a file's lines come from its text in sources, or as `all_lines` with its comments."""
    bare = trimmed(F.col("body"))
    found = found.withColumn("bare", bare).withColumn("lines", line_count(F.col("body")))
    # a text of up to 22 bytes has less than 4.5 bits a byte
    found = found.withColumn("entropy", byte_entropy(F.when(F.octet_length("bare") > 22, F.encode("bare", "UTF-8"))))
    b = F.col("bare")
    filled = b != ""
    mark = lambda x: F.count_if(filled & F.upper(b).contains(x))
    out = found.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("lines").alias("lines"),
        F.sum(F.octet_length("body")).alias("chars"),
        *(mark(x).alias(f"{x.lower()}_count") for x in ("TODO", "FIXME", "HACK", "XXX")),
        F.count_if(~filled).alias("empty_comments"),
        F.count_if(filled & (F.col("entropy") > 4.5) & (F.octet_length(b) > 20)).alias("high_entropy_comments"),
        F.count_if(filled & S.has_code_patterns(b)).alias("code_in_comments"),
        F.count_if(filled & (S.hits(b, ["http://", "https://", "ftp://"]) > 0)).alias("url_in_comments"),
        F.count_if(filled & S.has_base64_pattern(b)).alias("base64_in_comments"),
        *([] if sources is not None else [F.max("all_lines").alias("all_lines")]),
    )
    code = F.col("all_lines") - F.col("lines")
    if sources is not None:
        out = out.join(sources.select("file_id", line_count(F.col("text")).alias("all_lines")), "file_id")
    return out.withColumn("to_code_ratio", F.when(code > 0, F.round(F.col("lines") / code, 6))).drop("all_lines")
