"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from gneiss.llm import bytebpe, decontam, erasure, fingerprints, licenses, mixing, quality, sharding, simhash, spelling, substring, tokenbin, tokencount


def queries() -> dict:
    import corpus_pipeline

    return {
        "op1_sharding": sharding.op1_sharding,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_quality": quality.op3_quality,
        "op4_fingerprints": fingerprints.op4_fingerprints,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_token_ids": tokenbin.op6_token_ids,
        "op7_simhash": simhash.op7_simhash,
        "op8_token_counts": tokencount.op8_token_counts,
        "op9_mixing": mixing.op9_mixing,
        "op10_decontamination": decontam.op10_decontamination,
        "op11_spelling": spelling.op11_spelling,
        "op12_byte_bpe": bytebpe.op12_byte_bpe,
        "op13_erasure": erasure.op13_erasure,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": substring.ORACLE, "op11_spelling": spelling.ORACLE}
