"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, langid, line_dedup, mixing, near_dedup, packing, quality, suffix_dedup, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": langid.op3_language_id,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_minhash_near_dedup": near_dedup.op6_minhash_near_dedup,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_chat_format": chat.op9_chat_format,
    "op10_quality_rules": quality.op10_quality_rules,
    "mix_targets": mixing.mix_targets,
}

ORACLE_SQL = {
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "mix_targets": mixing.TARGETS_ORACLE,
    "op9_chat_format": chat.ORACLE,
    "op10_quality_rules": quality.ORACLE,
}
