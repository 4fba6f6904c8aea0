"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import backoff_model, bpe, centroid_clustering, exact_dedup, license_scan, mixing, quality_classifier, quality_rules, ranked_search, simhash, substring_dedup, token_counts, url_filter


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1_quality_rules,
        "op2_mixing": mixing.op2_mixing,
        "op3_bpe": bpe.op3_bpe,
        "op4_token_counts": token_counts.op4_token_counts,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_quality_classifier": quality_classifier.op9_quality_classifier,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_lm_scoring": backoff_model.op11_lm_scoring,
        "op12_centroid_clustering": centroid_clustering.op12_centroid_clustering,
        "op13_ranked_search": ranked_search.op13_ranked_search,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": url_filter.OP5_SQL,
        "op6_substring_dedup": substring_dedup.OP6_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op12_centroid_clustering": centroid_clustering.OP12_SQL,
        "op13_ranked_search": ranked_search.OP13_SQL,
    }
