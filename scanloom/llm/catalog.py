"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import embedding_dedup, exact_dedup, language_model, license_scan, mixing, packing, quality_model, quality_rules, ranking, resampling, sharding, simhash_dedup, url_filter

QUERIES = {
    "op1_source_budgets": mixing.op1_source_budgets,
    "op2_quality_classifier": quality_model.op2_quality_classifier,
    "op3_license_sentences": license_scan.op3_license_sentences,
    "op4_quality_cascade": quality_rules.op4_quality_cascade,
    "op5_trie_language_model": language_model.op5_trie_language_model,
    "op6_simhash_groups": simhash_dedup.op6_simhash_groups,
    "op7_url_cascade": url_filter.op7_url_cascade,
    "op8_cost_packing": packing.op8_cost_packing,
    "op9_byte_shards": sharding.op9_byte_shards,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_tied_places": ranking.op11_tied_places,
    "op12_target_resampling": resampling.op12_target_resampling,
    "op13_embedding_tiles": embedding_dedup.op13_embedding_tiles,
}

ORACLES = {
    "op1_source_budgets": mixing.ORACLE,
    "op3_license_sentences": license_scan.ORACLE,
    "op4_quality_cascade": quality_rules.ORACLE,
    "op7_url_cascade": url_filter.ORACLE,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_tied_places": ranking.ORACLE,
    "op12_target_resampling": resampling.ORACLE,
}
