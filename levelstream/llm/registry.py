"""The queries of this folder, by the name they are registered under."""

from __future__ import annotations

from . import chat_format, chunk_prints, embedding_dedup, hard_negatives, license_scan, mixing, piece_codes, ranked_search, simhash, substring_dedup, token_files, toxicity, url_filter

QUERIES = {
    "op1_chat_format": chat_format.query,
    "op2_mixing": mixing.query,
    "op3_token_files": token_files.query,
    "op4_embedding_dedup": embedding_dedup.query,
    "op5_chunk_prints": chunk_prints.query,
    "op6_license_scan": license_scan.query,
    "op7_piece_codes": piece_codes.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_simhash": simhash.query,
    "op10_toxicity": toxicity.query,
    "op11_ranked_search": ranked_search.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_url_filter": url_filter.query,
}

ORACLES = {"op1_chat_format": chat_format.ORACLE, "op4_embedding_dedup": embedding_dedup.ORACLE, "op11_ranked_search": ranked_search.ORACLE, "op12_hard_negatives": hard_negatives.ORACLE, "op13_url_filter": url_filter.ORACLE}
