"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ball_kmeans, chat, embeddings, hard_negatives, html_text, katz, mixing, ordinal, packing, pii, quality_rules, simhash, window_packing

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_katz": katz.op2_katz,
    "op3_chat": chat.op3_chat,
    "op4_pii": pii.op4_pii,
    "op5_ordinal": ordinal.op5_ordinal,
    "op6_embeddings": embeddings.op6_embeddings,
    "op7_html": html_text.op7_html,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_packing": packing.op9_packing,
    "op10_mixing": mixing.op10_mixing,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_window_packing": window_packing.op12_window_packing,
    "op13_ball_kmeans": ball_kmeans.op13_ball_kmeans,
}
SQL: dict[str, str] = {"op11_hard_negatives": hard_negatives.SQL, "op13_ball_kmeans": ball_kmeans.SQL}
