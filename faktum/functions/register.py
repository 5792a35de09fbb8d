"""Registers scalar expressions as SQL functions, and readers as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name and body; the argument is s.
SCALARS = {
    "is_hex_string": "octet_length(s) >= 8 AND octet_length(s) % 2 = 0 AND s RLIKE r'\\A(?:0[xX])?[0-9a-fA-F]*\\z'",
    "is_likely_base64": "octet_length(s) >= 16 AND octet_length(s) % 4 = 0 AND s RLIKE r'\\A[A-Za-z0-9+/=]*\\z' AND s RLIKE '[A-Z]' AND s RLIKE '[a-z]' AND (NOT contains(s, '=') OR endswith(s, '='))",
    "is_domain_like": "contains(s, '.') AND s RLIKE r'\\A[A-Za-z0-9.\\-]*\\z'",
    "file_stem": "regexp_replace(regexp_extract(s, r'[^/\\\\]*\\z', 0), r'\\A(\\.*[^.].*)\\.[^.]*\\z', '$1')",
}
_TYPES = {"file_stem": "STRING"}


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions that Catalyst inlines, and `archive_members(content, format)`."""
    from pyspark.sql.functions import udtf

    for name, body in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {_TYPES.get(name, 'BOOLEAN')} RETURN {body}")

    @udtf(returnType="ord bigint, path string, size_bytes bigint, entry_type string, method string, error string")
    class ArchiveMembers:
        def eval(self, content: bytes, archive_format: str):
            from faktum.sources.containers import members_of

            for m in members_of(bytes(content or b""), archive_format):
                yield m["ord"], m.get("path"), m.get("size_bytes"), m.get("entry_type"), m.get("method"), m.get("error")

    spark.udtf.register("archive_members", ArchiveMembers)
    return [*SCALARS, "archive_members"]
