"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tracklore.llm import chat_format, exact_dedup, importance, language_id, line_dedup, line_quality, mixing, pii, quality, sentence_pieces, simhash, toxicity, vector_codes

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_line_quality": line_quality.op7_line_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_personal_data": pii.op9_personal_data,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_quality": quality.op11_quality,
    "op12_importance": importance.op12_importance,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE = {
    "op5_line_dedup": line_dedup.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_line_quality": line_quality.OP7_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op12_importance": importance.OP12_SQL,
    "op13_vector_codes": vector_codes.OP13_SQL,
}
