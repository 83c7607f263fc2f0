"""The queries of this folder, and their SQL."""

from __future__ import annotations

from driftglass.llm import byte_bpe, chat, embedding_dedup, filter_audit, licenses, line_dedup, media, minhash, mixing, oracles, packing, quality, ranked_search, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1,
    "op2_toxicity": toxicity.op2,
    "op3_embedding_near_dedup": embedding_dedup.op3,
    "op4_minhash_near_dedup": minhash.op4,
    "op5_best_fit_packing": packing.op5,
    "op6_quality": quality.op6,
    "op7_media_columns": media.op7,
    "op8_license_scan": licenses.op8,
    "op9_mix_sources": mixing.op9,
    "op10_chat_format": chat.op10,
    "op11_ranked_search": ranked_search.op11,
    "op12_byte_bpe": byte_bpe.op12,
    "op13_filter_audit": filter_audit.op13,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op3_embedding_near_dedup": embedding_dedup.ORACLE,
    "op4_minhash_near_dedup": minhash.ORACLE,
} | oracles.ORACLES
