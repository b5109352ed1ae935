"""The queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import classifier, fingerprints, invariants, line_dedup, lm_scoring, mixing, ngram_join, packing, quality_rules, substring_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_quality_classifier": classifier.op4_quality_classifier,
        "op5_packing": packing.op5_packing,
        "op6_fingerprints": fingerprints.op6_fingerprints,
        "op7_mixing": mixing.op7_mixing,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_lm_scoring": lm_scoring.op10_lm_scoring,
        "quality_rules_ablations": quality_rules.op3_ablations,
    } | {name: make for name, (make, _) in invariants.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.OP1_SQL,
        "op2_substring_dedup": substring_dedup.OP2_SQL,
        "op3_quality_rules": quality_rules.OP3_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "quality_rules_ablations": quality_rules.OP3_ABLATIONS_SQL,
    } | {name: sql for name, (_, sql) in invariants.QUERIES.items()}
