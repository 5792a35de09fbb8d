"""The queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faktum.llm.exact_dedup import OP4_SQL, op4_exact_dedup
from faktum.llm.html_extraction import op9_html_extraction
from faktum.llm.language_id import op3_language_id, pages_language_id
from faktum.llm.license_scan import op11_license_scan
from faktum.llm.lm_scoring import op6_lm_scoring
from faktum.llm.near_dedup import op1_near_dedup
from faktum.llm.packing import op10_packing
from faktum.llm.pair_index import op7_bpe
from faktum.llm.phrases import OP12_SQL, op12_phrases
from faktum.llm.toxicity import op8_toxicity
from faktum.llm.url_filter import op2_url_filter
from faktum.llm.vector_codes import OP13_SQL, op13_vector_codes
from faktum.llm.vector_search import OP5_SQL, op5_top_k

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: tuple[Query, ...] = (op1_near_dedup, op2_url_filter, op3_language_id, op4_exact_dedup, op5_top_k, op6_lm_scoring, op7_bpe, op8_toxicity, op9_html_extraction, op10_packing, op11_license_scan, op12_phrases, op13_vector_codes, pages_language_id)


def queries() -> dict[str, Query]:
    return {x.__name__: x for x in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op5_top_k": OP5_SQL, "op12_phrases": OP12_SQL, "op13_vector_codes": OP13_SQL}
