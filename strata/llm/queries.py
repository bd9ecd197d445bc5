"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strata.llm import (
    exact_dedup, html_extract, language, licenses, mixing, packing, prefix_trie, quality, repair, simhash, spotsigs, toxicity, url_filter,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_packing": packing.op3_packing,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_document_fingerprints": spotsigs.op6_document_fingerprints,
        "op7_license_scan": licenses.op7_license_scan,
        "op8_quality_classifier": quality.op8_quality_classifier,
        "op9_language_id": language.op9_language_id,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_html_extraction": html_extract.op12_html_extraction,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op10_url_filter": url_filter.OP10_SQL,
        "op11_conversation_repair": repair.OP11_SQL,
        "op13_prefix_trie": prefix_trie.OP13_SQL,
    }
