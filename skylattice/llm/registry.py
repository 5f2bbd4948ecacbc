"""The subpackage's queries, and SQL that gives the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, lm_score, ngram_join, packing, phrases, pii, quality, spelling, substring_dedup, suffix_dedup, token_file


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_bpe": bpe.op2_bpe,
        "op3_lm_score": lm_score.op3_lm_score,
        "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
        "op5_pii_surrogates": pii.op5_pii_surrogates,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_quality_rules": quality.op7_quality_rules,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_token_counts": bpe.op10_token_counts,
        "op11_token_files": token_file.op11_token_files,
        "op12_phrases": phrases.op12_phrases,
        "op13_spelling": spelling.op13_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op3_lm_score": lm_score.SQL,
        "op4_suffix_dedup": suffix_dedup.SQL,
        "op6_substring_dedup": substring_dedup.SQL,
        "op7_quality_rules": quality.SQL,
        "op8_ngram_join": ngram_join.SQL,
        "op12_phrases": phrases.SQL,
        "op13_spelling": spelling.SQL,
    }
