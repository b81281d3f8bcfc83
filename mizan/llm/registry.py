"""Names of the training-data queries and of their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from mizan.llm import chat, decontam, fingerprint, mixing, neardup, packing, pitman_yor, sharding, spelling, tokens, toxicity, urls, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_token_output": tokens.op1,
        "op2_virtual_slot_sharding": sharding.op2,
        "op3_fingerprints": fingerprint.op3,
        "op4_lm_scoring": pitman_yor.op4,
        "op5_chat_formatting": chat.op5,
        "op6_toxicity": toxicity.op6,
        "op7_source_mixing": mixing.op7,
        "op8_url_templates": urls.op8,
        "op9_benchmark_decontamination": decontam.op9,
        "op10_minhash_near_dedup": neardup.op10,
        "op11_whitening": whitening.op11,
        "op12_spelling_variants": spelling.op12,
        "op13_packing": packing.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_formatting": chat.OP5_SQL,
        "op7_source_mixing": mixing.OP7_SQL,
        "op9_benchmark_decontamination": decontam.OP9_SQL,
        "op12_spelling_variants": spelling.OP12_SQL,
    }
