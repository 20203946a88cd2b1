"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from sextant.llm import chat, language_id, line_dedup, media, mixing, packing, quality_classifier, quality_rules, simhash_dedup, warc

QUERIES = {
    "op9_quality_classifier": quality_classifier.query,
    "op3_language_id": language_id.query,
    "op5_chat": chat.query,
    "op2_media": media.query,
    "op8_warc": warc.query,
    "op7_packing": packing.query,
    "op1_mixing": mixing.query,
    "op10_simhash_dedup": simhash_dedup.query,
    "op4_line_dedup": line_dedup.query,
    "op6_quality_rules": quality_rules.query,
    "llm_rule_ablations": quality_rules.ablation_query,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "llm_rule_ablations": quality_rules.ABLATION_ORACLE,
}
