"""Queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import (
    bpe,
    collocations,
    context_weighting,
    conversation_repair,
    decontaminate,
    line_dedup,
    packed,
    quality,
    secret_scan,
    sharding,
    simhash,
    unigram,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        url_filter.op1_url_filter,
        sharding.op2_balanced_shards,
        bpe.op3_byte_bpe,
        line_dedup.op4_line_dedup,
        packed.op5_packed_tokens,
        quality.op6_quality_rules,
        decontaminate.op7_decontamination,
        secret_scan.op8_secret_scan,
        simhash.op9_simhash,
        unigram.op10_token_counts,
        conversation_repair.op11_conversation_repair,
        collocations.op12_collocations,
        context_weighting.op13_context_weighting,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": url_filter.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality.ORACLE,
    "op12_collocations": collocations.ORACLE,
}
