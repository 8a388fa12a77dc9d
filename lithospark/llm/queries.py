"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, fingerprints, language, main_text, merkle, mixing, near_dedup, quality, sharding, substring_dedup, urls, vectors


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_language_id": language.op2_language_id,
        "op3_mixing": mixing.op3_mixing,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_bpe": bpe.op5_bpe,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_minhash_near_dedup": near_dedup.op7_minhash_near_dedup,
        "op8_url_filters": urls.op8_url_filters,
        "op9_nearest_neighbours": vectors.op9_nearest_neighbours,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "op11_html_extraction": main_text.op11_html_extraction,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_cross_tokenizer_alignment": alignment.op13_cross_tokenizer_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": mixing.OP3_SQL, "op8_url_filters": urls.OP8_SQL}
