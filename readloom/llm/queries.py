"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from readloom.llm import ann, brown_lm, cross_tokens, decontamination, language_id, mixing, ngram_join, sharding, token_counts, toxicity, url_filter, whitening, wrappers


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_lm": brown_lm.op1_brown_lm,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_kmeans_tree": ann.op4_kmeans_tree,
        "op5_mixing": mixing.op5_mixing,
        "op6_wrappers": wrappers.op6_wrappers,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_ngram_join": ngram_join.op8_ngram_join,
        "op9_language_id": language_id.op9_language_id,
        "op10_sharding": sharding.op10_sharding,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_cross_tokens": cross_tokens.op12_cross_tokens,
        "op13_whitening": whitening.op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontamination.OP3_SQL, "op8_ngram_join": ngram_join.OP8_SQL}
