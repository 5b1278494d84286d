"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from ranklane.llm import bpe, exact_dedup, html_text, language_id, license_scan, ngram_join, packing, quality_rules, substring_dedup, toxicity

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_ngram_jaccard_join": ngram_join.op5_ngram_jaccard_join,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_html_extraction": html_text.op9_html_extraction,
    "op10_language_id": language_id.op10_language_id,
    "license_base_counts": license_scan.license_base_counts,
}

ORACLES = {
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_quality_rules": quality_rules.OP7_SQL,
    "license_base_counts": license_scan.BASE_SQL,
}
