"""All queries but those of the corpus operators."""

from faktum import queries_files, queries_identify, queries_incremental, queries_more, queries_provenance, queries_scripts, queries_sources, queries_text  # noqa: F401
from faktum.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
