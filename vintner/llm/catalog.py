"""The corpus queries and their DuckDB statements, by name."""

from . import (chat, fill_middle, jaccard_join, mixing, near_vectors, phrases, pieces, pii, quality,
               substring_dedup, token_counts, token_files, topk)

QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_jaccard_join": jaccard_join.query,
    "op3_pieces": pieces.query,
    "op4_mixing": mixing.query,
    "op5_chat": chat.query,
    "op6_quality": quality.query,
    "op7_top_k": topk.query,
    "op8_token_counts": token_counts.query,
    "op9_pii": pii.query,
    "op10_near_vectors": near_vectors.query,
    "op11_phrases": phrases.query,
    "op12_fill_middle": fill_middle.query,
    "op13_token_files": token_files.query,
}

ORACLES = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op2_jaccard_join": jaccard_join.ORACLE,
    "op7_top_k": topk.ORACLE,
    "op10_near_vectors": near_vectors.ORACLE,
    "op11_phrases": phrases.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}
