"""Registered queries of this subpackage, (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from . import best_fit_packing, byte_bpe, chat_format, html_wrapper, language_id, merkle_fingerprint, minhash_dedup, quality_rules, sharding, url_filter

QUERIES = {
    "op1_sharding": sharding.op1_query,
    "op2_merkle_fingerprint": merkle_fingerprint.op2_query,
    "op3_quality_mcd": quality_rules.op3_query,
    "op4_language_centroids": language_id.op4_query,
    "op5_best_fit_packing": best_fit_packing.op5_query,
    "op6_byte_bpe": byte_bpe.op6_query,
    "op7_minhash_near_dedup": minhash_dedup.op7_query,
    "op8_chat_format": chat_format.op8_query,
    "op9_html_wrapper": html_wrapper.op9_query,
    "op10_url_filter": url_filter.op10_query,
}

ORACLES: dict[str, str] = {
    "op1_sharding": sharding.ORACLE,
    "op2_merkle_fingerprint": merkle_fingerprint.ORACLE,
    "op3_quality_mcd": quality_rules.ORACLE,
    "op7_minhash_near_dedup": minhash_dedup.ORACLE,
    "op8_chat_format": chat_format.ORACLE,
    "op9_html_wrapper": html_wrapper.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
