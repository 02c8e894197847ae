"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tideline.llm import bpe, chat, decontam, near_dup, pii, quality, secrets, sharding, suffix_dedup, url_filters

QUERIES = {
    "op1_quality_sketches": quality.op1_quality_sketches,
    "op2_prefix_targets": chat.op2_prefix_targets,
    "op3_two_stage_suffixes": suffix_dedup.op3_two_stage_suffixes,
    "op4_secret_randomness": secrets.op4_secret_randomness,
    "op5_hilbert_shards": sharding.op5_hilbert_shards,
    "op6_order_minhash": near_dup.op6_order_minhash,
    "op7_bpe_automaton": bpe.op7_bpe_automaton,
    "op8_minhash_containment": decontam.op8_minhash_containment,
    "op9_char_bilstm_crf": pii.op9_char_bilstm_crf,
    "op10_url_templates": url_filters.op10_url_templates,
}
ORACLE_SQL = {
    "op1_quality_sketches": quality.OP1_SQL,
    "op8_minhash_containment": decontam.OP8_SQL,
    "op10_url_templates": url_filters.OP10_SQL,
}
