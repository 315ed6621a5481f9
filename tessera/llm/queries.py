"""Queries ``opN_<name>`` of this subpackage and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from tessera.llm import exact_dedup, mixing, neighbours, packing, pii, quality, scoring, simhash, substring_dedup, toxicity


def queries() -> dict:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_simhash": simhash.op2_simhash,
        "op3_pack": packing.op3_pack,
        "op4_remove_repeats": substring_dedup.op4_remove_repeats,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_score": scoring.op6_score,
        "op7_quality": quality.op7_quality,
        "op8_neighbours": neighbours.op8_neighbours,
        "op9_exact_dedup": exact_dedup.op9_exact_dedup,
        "op10_pseudonymise": pii.op10_pseudonymise,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.SQL,
        "op9_exact_dedup": exact_dedup.SQL,
    }
