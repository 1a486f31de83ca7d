"""The llm queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, bpe, conversations, langid, line_dedup, minhash, oracles, packing, quality, resampling, secrets, substring_dedup, suffix_dedup, warc

QUERIES = {
    "op1_hilbert_packing": packing.query,
    "op2_minhash_near_dedup": minhash.query,
    "op3_secret_scan": secrets.query,
    "op4_warc_salvage": warc.query,
    "op5_substring_dedup": substring_dedup.query,
    "op6_suffix_quality": quality.query,
    "op7_byte_cnn_langid": langid.query,
    "op8_tree_bpe": bpe.query,
    "op9_line_dedup": line_dedup.query,
    "op10_adaptive_ann": ann.query,
    "op11_conversation_repair": conversations.query,
    "op12_importance_resampling": resampling.query,
    "op13_suffix_array_dedup": suffix_dedup.query,
}
ORACLES: dict[str, str] = {
    "op2_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op4_warc_salvage": warc.ORACLE,
    "op5_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op9_line_dedup": line_dedup.ORACLE,
    "op12_importance_resampling": resampling.ORACLE,
    "op13_suffix_array_dedup": oracles.SUFFIX_DEDUP,
}
