"""Registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyloom.llm import (
    alignment, conversations, decontaminate, embedding_dedup, license_scan, line_dedup, neighbours, ngram_jaccard, packing, secret_scan, token_counts, toxicity, warc,
)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
        "op3_license_scan": license_scan.op3_license_scan,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_harmonic_packing": packing.op5_harmonic_packing,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_benchmark_decontamination": decontaminate.op9_benchmark_decontamination,
        "op10_archive_convert": warc.op10_archive_convert,
        "op11_nearest_neighbours": neighbours.op11_nearest_neighbours,
        "op12_conversation_repair": conversations.op12_conversation_repair,
        "op13_tokenizer_alignment": alignment.op13_tokenizer_alignment,
    }


def all_oracles() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_dedup.ORACLE,
        "op2_ngram_jaccard": ngram_jaccard.ORACLE,
        "op8_line_dedup": line_dedup.ORACLE,
        "op9_benchmark_decontamination": decontaminate.ORACLE,
        "op10_archive_convert": warc.ORACLE,
    }
