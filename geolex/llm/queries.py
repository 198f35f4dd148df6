"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geolex.llm import (
    op1_simhash_near_dedup,
    op10_inverted_multi_index,
    op11_best_fit_packing,
    op12_ranked_search,
    op13_phrase_collocations,
    op2_mix_sources,
    op3_exact_dedup,
    op4_license_scan,
    op5_language_id,
    op6_secret_scan,
    op7_token_counts,
    op8_quality_crf,
    op9_byte_bpe,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup.op1_simhash_near_dedup,
        "op2_mix_sources": op2_mix_sources.op2_mix_sources,
        "op3_exact_dedup": op3_exact_dedup.op3_exact_dedup,
        "op4_license_scan": op4_license_scan.op4_license_scan,
        "op5_language_id": op5_language_id.op5_language_id,
        "op6_secret_scan": op6_secret_scan.op6_secret_scan,
        "op7_token_counts": op7_token_counts.op7_token_counts,
        "op8_quality_crf": op8_quality_crf.op8_quality_crf,
        "op9_byte_bpe": op9_byte_bpe.op9_byte_bpe,
        "op10_inverted_multi_index": op10_inverted_multi_index.op10_inverted_multi_index,
        "op11_best_fit_packing": op11_best_fit_packing.op11_best_fit_packing,
        "op12_ranked_search": op12_ranked_search.op12_ranked_search,
        "op13_phrase_collocations": op13_phrase_collocations.op13_phrase_collocations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_mix_sources": op2_mix_sources.ORACLE_SQL,
        "op3_exact_dedup": op3_exact_dedup.ORACLE_SQL,
        "op4_license_scan": op4_license_scan.ORACLE_SQL,
        "op12_ranked_search": op12_ranked_search.ORACLE_SQL,
        "op13_phrase_collocations": op13_phrase_collocations.ORACLE_SQL,
    }
