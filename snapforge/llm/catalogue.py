"""The queries of this subpackage and, where SQL can express them, the equivalent DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from snapforge.llm import alignment, byte_bpe, chat, exact_dedup, html_text, packing, periodic_runs, repeated_windows, sharding, simhash, toxicity, url_filter, winnowing

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_sharding": sharding.op2_sharding,
    "op3_chat": chat.op3_chat,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html_text": html_text.op5_html_text,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_packing": packing.op9_packing,
    "op10_winnowing": winnowing.op10_winnowing,
    "op11_alignment": alignment.op11_alignment,
    "op12_repeated_windows": repeated_windows.op12_repeated_windows,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": sharding.ORACLE_SQL,
    "op3_chat": chat.ORACLE_SQL,
    "op6_url_filter": url_filter.ORACLE_SQL,
    "op8_exact_dedup": exact_dedup.ORACLE_SQL,
    "op12_repeated_windows": repeated_windows.ORACLE_SQL,
}
