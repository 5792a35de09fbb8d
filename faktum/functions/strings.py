"""Classifiers of string literals, identifiers, comments and call targets, as boolean expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the classifiers look for.
TLDS = [".com", ".net", ".org", ".io", ".dev", ".co", ".xyz", ".ru", ".cn", ".de", ".uk", ".info", ".biz", ".cc", ".top", ".online", ".site", ".tk", ".ml", ".ga"]
EMBEDDED_CODE = ["function(", "function ", "eval(", "exec(", "import ", "require(", "<script", "<?php", "def ", "class ", "system.", "runtime.", "process."]
SHELL = [
    "/bin/sh", "/bin/bash", "cmd.exe", "powershell", "curl ", "wget ", "chmod ", "chown ", "rm -", "dd if=", "nc -", "netcat",
    "python -c", "perl -e", "ruby -e", "nohup ", "| sh", "| bash", "2>&1", ">/dev/null", "$(", "`",
]
SQL = ["SELECT ", "INSERT ", "UPDATE ", "DELETE ", "DROP ", "CREATE ", "ALTER ", "UNION ", " FROM ", " WHERE ", " AND ", " OR ", "--", "';", "1=1", "1 = 1"]
COMMENT_CODE = ["function(", "def ", "class ", "if (", "for (", "while (", "return ", "import ", "require(", "var ", "let ", "const ", "eval(", "exec(", "= function", "=> {"]
PATH_PARTS = ["/bin/", "/etc/", "/tmp/", "/var/", "\\Windows\\", "\\System32\\", "\\AppData\\"]
SCHEMES = ["http://", "https://", "ftp://", "file://", "ws://", "wss://"]
SEQUENCE_STEMS = ["var", "tmp", "temp", "arg", "param", "item", "val", "x", "y", "z", "i", "j", "k"]
KEYBOARD = ["qwerty", "qwert", "asdf", "asdfg", "zxcv", "zxcvb", "qazwsx", "qaz", "wsx", "edc", "rfv", "ytrewq", "fdsa", "gfdsa", "vcxz"]


def hits(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (text.contains(x).cast("int") for x in needles))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def is_likely_base64(s: Column) -> Column:
    n = F.octet_length(s)
    padded = ~s.contains("=") | s.endswith("=")
    return (n >= 16) & (n % 4 == 0) & s.rlike(r"\A[A-Za-z0-9+/=]*\z") & s.rlike("[A-Z]") & s.rlike("[a-z]") & padded


def is_hex_string(s: Column) -> Column:
    n = F.octet_length(s)
    return (n >= 8) & (n % 2 == 0) & s.rlike(r"\A(?:0[xX])?[0-9a-fA-F]*\z")


def has_url_encoding(s: Column) -> Column:
    """More than three escapes with a byte after them."""
    return F.regexp_count(s, F.lit(r"(?s)%[0-9a-fA-F]{2}")) > 3


def has_unicode_heavy(s: Column) -> Column:
    marks = F.regexp_count(s, F.lit(r"\\[ux]|&#")) + F.regexp_count(s, F.lit("&#x"))
    return marks >= 5


def is_url(s: Column) -> Column:
    return any_of([F.lower(s).startswith(x) for x in SCHEMES])


def is_file_path(s: Column) -> Column:
    rooted = s.startswith("/") & (F.octet_length(s) > 1) & ~s.startswith("//")
    return rooted | s.rlike(r"\A[A-Za-z]:[\\/]") | any_of([s.startswith(x) for x in ("./", "../", "~")]) | any_of([s.contains(x) for x in PATH_PARTS])


def is_ip_address(s: Column) -> Column:
    octet = r"\+?0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    four = F.size(F.split(s, r"\.", -1)) == 4
    colons = F.regexp_count(s, F.lit(":"))
    six = s.contains(":") & ~s.contains("://") & colons.between(2, 7) & s.rlike(r"\A[0-9a-fA-F:]*\z")
    return F.when(four, s.rlike(rf"\A{octet}(?:\.{octet}){{3}}\z")).otherwise(six)


def is_email(s: Column) -> Column:
    return (F.octet_length(s) >= 5) & s.rlike(r"(?s)\A[^@]+@[^@.](?:[^@]*[^@.])?\z") & F.substring_index(s, "@", -1).contains(".")


def is_domain(s: Column) -> Column:
    return s.contains(".") & any_of([F.lower(s).endswith(x) for x in TLDS]) & s.rlike(r"\A[A-Za-z0-9.\-]*\z")


def has_embedded_code(s: Column) -> Column:
    return hits(F.lower(s), EMBEDDED_CODE) > 0


def has_shell_command(s: Column) -> Column:
    return hits(F.lower(s), SHELL) > 0


def has_sql_pattern(s: Column) -> Column:
    return hits(F.upper(s), SQL) >= 2


def has_code_patterns(s: Column) -> Column:
    return hits(F.lower(s), COMMENT_CODE) >= 2


def has_base64_pattern(s: Column) -> Column:
    """A word of at least 20 bytes, over nine tenths of them of the base64 alphabet, in both cases."""
    word = lambda x: (F.octet_length(x) >= 20) & (F.regexp_count(x, F.lit("[A-Za-z0-9+/=]")) * 10 > F.octet_length(x) * 9) & x.rlike("[A-Z]") & x.rlike("[a-z]")
    return F.exists(F.split(s, r"(?U)\s+"), word)


def is_hex_like(s: Column) -> Column:
    n = F.octet_length(s)
    return (n >= 6) & (n % 2 == 0) & (F.regexp_count(s, F.lit("[0-9a-fA-F]")) * 10 > n * 9)


def is_base64_like(s: Column) -> Column:
    n = F.octet_length(s)
    return (n >= 8) & (F.regexp_count(s, F.lit("[A-Za-z0-9+/=]")) * 20 > n * 19) & s.rlike("[A-Z]") & s.rlike("[a-z]") & s.rlike("[0-9]")


def is_sequential(s: Column) -> Column:
    return s.rlike(r"\A[A-Za-z][0-9]?\z") | s.rlike(rf"(?i)\A(?:{'|'.join(SEQUENCE_STEMS)})[0-9]\z")


def has_keyboard_walk(s: Column) -> Column:
    return any_of([F.lower(s).contains(x) for x in KEYBOARD])


def call_target_kind(t: Column) -> Column:
    """`clean`, `dynamic` or `obfuscated`, of a shell command's name."""
    bare = F.regexp_replace(t, "[\"']", "")
    decodes = bare.contains("base64") | bare.contains("xxd") | (bare.contains("printf") & bare.rlike(r"\\[xX0-7]")) | (bare.contains("echo") & ~bare.contains("|"))
    welded = bare.rlike(r"(?s).*[A-Za-z0-9]\$") & ((F.regexp_count(bare, F.lit(r"\$")) >= 2) | bare.contains("$@") | bare.contains("$*"))
    return (
        F.when(t.contains("/"), "clean")
        .when(bare.contains("$(") | bare.contains("`"), F.when(decodes, "obfuscated").otherwise("dynamic"))
        .when(bare.rlike("[ \t\n\r]"), "clean")
        .when((F.regexp_count(bare, F.lit(r"\\")) >= 2) | welded, "obfuscated")
        .when(bare.startswith("$"), "dynamic")
        .otherwise("clean")
    )
