"""Text metrics as expressions over one string column.

Lengths are in bytes of UTF-8.  Lines end at LF; one CR before it goes with
it; text after the last LF is a line only if there is some.  White space is
Unicode's.  A metric of zero is left out (null) unless noted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from faktum.functions.bytes import byte_facts, flat, in_stretches, listed

SPACE = r"(?U)\s"
#: White space other than the plain kinds, and characters that show nothing.
UNUSUAL = "[\u00a0\u2000-\u200a\u202f\u205f\u3000]"
INVISIBLE = "[\ufe00-\ufe0f\u200b-\u200d\u2060\ufeff\\x{E0100}-\\x{E01EF}\\x{E0001}-\\x{E007F}]"
SPANS, SPAN_CAP = "array<struct<offset:bigint,len:bigint>>", 64
ART = r"[=\-*#+|/\\_.]"


def bound(x: Column, f) -> Column:
    """f(x), for which x is computed once, however often and in whatever lambdas f uses it."""
    return F.transform(F.array(x), f)[0]


def positive(x: Column) -> Column:
    """The value as a double; null for zero."""
    x = x.cast("double")
    return F.when(x > 0, x)


def lines(text: Column) -> Column:
    parts = F.split(text, "\n", -1)
    parts = F.when(text.endswith("\n"), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.transform(parts, lambda x: F.regexp_replace(x, r"\r\z", "")))


def line_count(text: Column) -> Column:
    """How many lines there are, without making them."""
    return (F.regexp_count(text, F.lit("\n")) + F.when((text == "") | text.endswith("\n"), 0).otherwise(1)).cast("int")


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def line_facts(text: Column) -> Column:
    """All line metrics as one struct, for which a text is cut into lines once; to be selected before its fields are."""
    return bound(lines(text), lambda rows: F.struct(*(v.alias(k) for k, v in _of_lines(rows).items())))


def line_metrics(text: Column) -> dict[str, Column]:
    return _of_lines(lines(text))


def _of_lines(rows: Column) -> dict[str, Column]:
    sizes = F.transform(rows, F.octet_length)
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x)
    n = F.when(F.size(rows) > 0, F.size(rows)).cast("double")  # null for no lines, as all that is divided by it
    mean = total / n
    squares = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    # n * squares - total * total, in longs where these hold it
    spread = F.coalesce(F.try_subtract(F.try_multiply(F.size(rows).cast("long"), squares), F.try_multiply(total, total)).cast("double"), n * squares - total.cast("double") * total) / n
    filled = F.filter(rows, lambda x: x.rlike(r"(?U)\S"))
    over = lambda k: positive(F.size(F.filter(sizes, lambda x: x > k)))
    lead = lambda x: F.regexp_extract(x, r"\A[ \t]*", 0)
    # runs of white space within lines; single ones are most, and need not be taken out
    longer = F.flatten(F.transform(F.filter(rows, lambda x: x.rlike(r"[ \t]{2}")), lambda x: F.regexp_extract_all(F.regexp_replace(x, r"(?U)\A\s+", ""), F.lit(r"[ \t]{2,}(?=[^ \t])"), F.lit(0))))
    single = F.exists(rows, lambda x: x.rlike(r"(?sU)\A\s*+\S.*?[ \t][^ \t]"))
    marks = lambda x: F.length(x) - F.length(F.regexp_replace(x, f"{ART}+", ""))
    # over seven tenths of at least 20 bytes are more than 14 marks
    art = lambda x: (F.octet_length(x) >= 20) & (marks(x) > 14) & (F.octet_length(trimmed(x)) >= 20) & (marks(x) * 10 > F.octet_length(trimmed(x)) * 7)
    return {
        "total_lines": F.size(rows).cast("double"),
        "avg_line_length": mean,
        "max_line_length": positive(F.array_max(sizes)),
        "line_length_stddev": positive(F.sqrt(spread / n)),
        "lines_over_200": over(200),
        "lines_over_500": over(500),
        "lines_over_1000": over(1000),
        "last_line_length": positive(F.octet_length(F.try_element_at(filled, F.lit(-1)))),
        "empty_line_ratio": positive((F.size(rows) - F.size(filled)) / n),
        "mixed_indent": positive((F.exists(rows, lambda x: lead(x).contains("\t")) & F.exists(rows, lambda x: lead(x).contains(" "))).cast("int")),
        "trailing_whitespace_lines": positive(F.size(F.filter(rows, lambda x: x.rlike(r"(?U)\s\z")))),
        "max_inline_whitespace_run": positive(F.coalesce(F.array_max(F.transform(longer, F.length)), single.cast("int"))),
        "ascii_art_lines": positive(F.size(F.filter(rows, art))),
    }


def longest_line_spans(text: Column) -> Column:
    """The place of the first of the longest lines, in bytes of UTF-8, terminators counted; empty if all lines are."""

    def first(raw: Column, sizes: Column, most: Column) -> Column:
        before = F.slice(raw, F.lit(1), (F.array_position(sizes, most) - 1).cast("int"))
        start = F.aggregate(before, F.lit(0).cast("long"), lambda at, x: at + F.octet_length(x) + 1)
        return F.when(most > 0, F.array(F.struct(start.alias("offset"), most.cast("long").alias("len")))).otherwise(F.array().cast(SPANS))

    def of_lines(raw: Column) -> Column:
        sizes = F.transform(raw, lambda x: F.octet_length(x) - F.when(x.endswith("\r"), 1).otherwise(0))
        return bound(sizes, lambda own: bound(F.array_max(own), lambda most: first(raw, own, most)))

    return bound(F.split(text, "\n", -1), of_lines)


def invisible_spans(text: Column) -> Column:
    """Where runs of invisible characters stand, in bytes of UTF-8: the first SPAN_CAP.  A leading byte order mark is none."""
    shown = F.when(text.startswith("\ufeff"), F.concat(F.lit("\u20ac"), F.substr(text, F.lit(2)))).otherwise(text)
    pattern = f"{INVISIBLE}+"  # one class: alternatives would be matched by a call for each character of a run
    empty = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.octet_length(x["before"])
        size = F.octet_length(x["hidden"]).cast("long")
        return F.struct((start + size).alias("at"), F.concat(state["spans"], F.array(F.struct(start.alias("offset"), size.alias("len")))).alias("spans"))

    def of_text(shown: Column) -> Column:
        hidden = F.slice(F.regexp_extract_all(shown, F.lit(pattern), F.lit(0)), 1, SPAN_CAP)
        # the text before each run; behind the last one stands the rest, without a run
        parts = F.arrays_zip(F.split(shown, pattern, SPAN_CAP + 1).alias("before"), hidden.alias("hidden"))
        return F.aggregate(F.filter(parts, lambda x: x["hidden"].isNotNull()), empty, step, lambda state: state["spans"])

    return bound(shown, of_text)


def _invisible(values: pa.Array) -> pa.Array:
    """All runs of a column of UTF-8: the bytes that can begin an invisible character are looked at together."""
    raw, offsets = flat(values)
    raw, offsets = np.append(raw[offsets[0] : offsets[-1]], np.zeros(3, np.uint8)), offsets - offsets[0]
    at = np.flatnonzero(np.isin(raw, (0xE2, 0xEF, 0xF3)))
    a, b, c, d = (raw[at + k].astype(np.int64) for k in range(4))
    mark = (a == 0xEF) & (b == 0xBB) & (c == 0xBF)
    low = ((c & 0x3F) << 6) | (d & 0x3F)
    short = mark | ((a == 0xEF) & (b == 0xB8) & (c < 0x90)) | ((a == 0xE2) & (((b == 0x80) & (c >= 0x8B) & (c <= 0x8D)) | ((b == 0x81) & (c == 0xA0))))
    long_ = (a == 0xF3) & (b == 0xA0) & (((low >= 0x01) & (low <= 0x7F)) | ((low >= 0x100) & (low <= 0x1EF)))
    of = np.searchsorted(offsets, at, "right") - 1
    hidden = (short | long_) & ~(mark & (at == offsets[of]))
    at, of, size = at[hidden], of[hidden], np.where(long_, 4, 3)[hidden]
    new = np.append(True, (at[1:] != at[:-1] + size[:-1]) | (of[1:] != of[:-1]))[: len(at)]
    first = np.flatnonzero(new)
    length = np.add.reduceat(size, first) if len(first) else size
    return listed(np.bincount(of[first], minlength=len(values)), offset=(at - offsets[of])[first], len=length.astype(np.int64))


def all_invisible_spans(text: Column) -> Column:
    """Where all runs of invisible characters stand, as `invisible_spans` gives the first; the time grows with the text alone."""
    return F.when(text.isNotNull(), F.arrow_udf(lambda x: in_stretches(x, _invisible), SPANS)(text))


def char_metrics(text: Column) -> dict[str, Column]:
    n = F.octet_length(text)
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    without = lambda pattern: F.regexp_replace(text, f"{pattern}+", "")  # noqa: E731 - runs are fewer than the characters of common kinds
    digits, letters = n - F.octet_length(without("[0-9]")), n - F.octet_length(without("[A-Za-z]"))
    tokens = F.split(text, r"(?U)\s+")
    return {
        "whitespace_ratio": positive((F.length(text) - F.length(without(SPACE))) / n),
        "tab_count": positive(count("\t")),
        "space_count": positive(n - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))),
        "unusual_whitespace": positive(count(UNUSUAL)),
        "invisible_chars": positive(count(INVISIBLE) - F.when(text.startswith("\ufeff"), 1).otherwise(0)),
        "long_token_count": positive(F.size(F.filter(tokens, lambda x: F.octet_length(x) > 100))),
        "repeated_char_sequences": positive(count(r"(?s)(.)\1{9,}")),
        "digit_ratio": positive(digits / F.when(digits + letters > 0, digits + letters)),
    }


def escape_metrics(text: Column) -> dict[str, Column]:
    """Escapes are taken from left to right: \\xHH is four bytes; \\u and \\U two, if 4 or 8 bytes follow; \\0 to \\7 two."""
    some = text.contains("\\")
    raw = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")  # a character for each byte
    count = lambda x, pattern: F.when(some, F.regexp_count(x, F.lit(pattern))).otherwise(0)
    short, long_ = count(raw, r"(?s)\\u(?=.{4})"), count(raw, r"(?s)\\U(?=.{8})")
    hexes = count(text, r"\\x[0-9a-fA-F]{2}")
    octal = count(text, r"\\[0-7]")
    return {
        "hex_escape_count": positive(hexes),
        "unicode_escape_count": positive(short + long_),
        "octal_escape_count": positive(octal),
        "escape_density": positive((hexes + short + long_ + octal) * 100.0 / F.octet_length(text)),
    }


def byte_metrics(text: Column) -> dict[str, Column]:
    """From the histogram of bytes, made once by an Arrow pass."""
    return metrics_of_bytes(byte_facts(F.encode(text, "UTF-8")), F.octet_length(text))


def metrics_of_bytes(facts: Column, n: Column) -> dict[str, Column]:
    return {
        "char_entropy": facts["entropy"],
        "unique_chars": facts["kinds"].cast("double"),
        "most_common_char_codepoint": F.when(facts["common"] >= 0, facts["common"]).cast("double"),
        "most_common_char_is_null": F.when(facts["common"] >= 0, (facts["common"] == 0).cast("double")),
        "most_common_ratio": F.when(facts["common"] >= 0, facts["common_count"] / n),
        "non_ascii_ratio": positive(facts["high"] / n),
        "non_printable_ratio": positive(facts["odd"] / n),
        "null_byte_count": positive(facts["zeros"]),
        "high_byte_ratio": positive(facts["high"] / n),
    }


def text_metrics(text: Column) -> dict[str, Column]:
    """All metrics of a text by their names after `text.`; all null for an empty or null text."""
    own = byte_metrics(text) | line_metrics(text) | char_metrics(text) | escape_metrics(text)
    return {k: F.when(text != "", v) for k, v in own.items()}


def sentence_like(text: Column) -> Column:
    """At least 12 bytes, two spaces, three tokens, and two tokens of two letters."""
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")
    wordy = F.filter(tokens, lambda x: F.regexp_count(x, F.lit(r"\p{IsAlphabetic}")) >= 2)
    return (F.octet_length(text) >= 12) & (F.regexp_count(text, F.lit(" ")) >= 2) & (F.size(tokens) >= 3) & (F.size(wordy) >= 2)
