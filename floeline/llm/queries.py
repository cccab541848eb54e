"""Queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from floeline.llm import bpe, exact_dedup, hpy, langid, media, mixing, near_dedup, quality, substrings, toxicity


def queries() -> dict:
    return {
        "op1_bpe": bpe.op1_bpe,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_language_id": langid.op5_language_id,
        "op6_near_dedup": near_dedup.op6_near_dedup,
        "op7_hpy_score": hpy.op7_hpy_score,
        "op8_media_columns": media.op8_media_columns,
        "op9_quality": quality.op9_quality,
        "op10_suffix_dedup": substrings.op10_suffix_dedup,
    }


def oracle_sql() -> dict:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL}
