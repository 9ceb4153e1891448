"""The query of each operator and, where SQL can express it, the SQL to check it against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadgrain.llm import (
    alignment,
    exact,
    jaccard,
    language,
    lexicon,
    licences,
    manifest,
    neighbours,
    packing,
    privacy,
    repetition,
    toxicity,
    wavelet,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_exact_dedup": exact.op1_exact_dedup,
        "op2_personal_data": privacy.op2_personal_data,
        "op3_neighbours": neighbours.op3_neighbours,
        "op4_lexicon_bpe": lexicon.op4_lexicon_bpe,
        "op5_language_id": language.op5_language_id,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_licence_scan": licences.op7_licence_scan,
        "op8_near_duplicates": jaccard.op8_near_duplicates,
        "op9_token_shards": wavelet.op9_token_shards,
        "op10_packing": packing.op10_packing,
        "op11_token_alignment": alignment.op11_token_alignment,
        "op12_merkle_manifest": manifest.op12_merkle_manifest,
        "op13_repetition_rules": repetition.op13_repetition_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact.SQL,
        "op7_licence_scan": licences.sql(),
        "op8_near_duplicates": jaccard.SQL,
        "op12_merkle_manifest": manifest.sql(),
        "op13_repetition_rules": repetition.sql(),
    }
