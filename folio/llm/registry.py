"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontamination, license_scan, lm_score, ngram_jaccard, quality_rules, sharding, substring_dedup, token_counts, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_lm_score": lm_score.op4_lm_score,
    "op5_ngram_jaccard": ngram_jaccard.op5_ngram_jaccard,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_sharding": sharding.op7_sharding,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
}

ORACLES = {
    "op4_lm_score": lm_score.SQL,
    "op5_ngram_jaccard": ngram_jaccard.SQL,
    "op9_decontamination": decontamination.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
}
