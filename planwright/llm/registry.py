"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from planwright.llm import bloom_lm, exact_dedup, fingerprint, language_id, line_dedup, near_dedup, packing, piece_bpe, span_dedup, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_syncmer_fingerprint": fingerprint.op1_syncmer_fingerprint,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_sentence_spans": span_dedup.op3_sentence_spans,
        "op4_minhash_hamming": near_dedup.op4_minhash_hamming,
        "op5_piece_bpe": piece_bpe.op5_piece_bpe,
        "op6_bloom_lm": bloom_lm.op6_bloom_lm,
        "op7_language_id": language_id.op7_language_id,
        "op8_best_fit": packing.op8_best_fit,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op4_minhash_hamming": near_dedup.SQL, "op9_line_dedup": line_dedup.SQL}
