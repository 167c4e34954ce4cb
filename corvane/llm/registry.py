"""The queries and SQL of this subpackage."""

from __future__ import annotations

from . import exact_dedup, language_id, license_scan, near_dedup, packing, piece_transducer, quality, sharding, substring_dedup, token_counts

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_sentencepiece": piece_transducer.op2_sentencepiece,
    "op3_language_id": language_id.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_minhash_near_dedup": near_dedup.op5_minhash_near_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_packing": packing.op10_packing,
}
ORACLES = {
    "op1_license_scan": license_scan.ORACLE,
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op5_minhash_near_dedup": near_dedup.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op9_quality_rules": quality.ORACLE,
}
