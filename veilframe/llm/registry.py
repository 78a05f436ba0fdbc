"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from veilframe.llm import (
    byte_bpe,
    collocations,
    decontamination,
    language_id,
    merkle,
    plane_files,
    quality_model,
    quality_rules,
    sharding,
    simhash,
    substring_dedup,
    suffix_dedup,
    toxicity,
)


def queries() -> dict:
    """Query name to callable of (spark, sf_dir)."""
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op1_quality_model": quality_model.op1,
        "op2_byte_bpe": byte_bpe.op2,
        "op3_toxicity": toxicity.op3,
        "op4_plane_files": plane_files.op4,
        "op5_substring_dedup": substring_dedup.op5,
        "op6_language_id": language_id.op6,
        "op7_suffix_dedup": suffix_dedup.op7,
        "op8_simhash": simhash.op8,
        "op9_decontamination": decontamination.op9,
        "op10_quality_rules": quality_rules.op10,
        "op11_merkle_manifest": merkle.op11,
        "op12_collocations": collocations.op12,
        "op13_virtual_slots": sharding.op13,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express."""
    return {
        "op5_substring_dedup": substring_dedup.OP5_SQL,
        "op9_decontamination": decontamination.OP9_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
        "op11_merkle_manifest": merkle.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
    }
