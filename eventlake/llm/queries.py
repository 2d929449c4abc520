"""The queries of the training-data operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import byte_pairs, chat, decontamination, extraction, line_dedup, media, mixing, near_dedup, periodic_runs, quality, sharding, sql, substring_dedup, vector_codes

QUERIES = {
    "op1_media_columns": media.op1,
    "op2_main_text": extraction.op2,
    "op3_mixing": mixing.op3,
    "op4_line_dedup": line_dedup.op4,
    "op5_quality": quality.op5,
    "op6_substring_dedup": substring_dedup.op6,
    "op7_decontamination": decontamination.op7,
    "op8_chat_format": chat.op8,
    "op9_sharding": sharding.op9,
    "op10_near_dedup": near_dedup.op10,
    "op11_byte_bpe": byte_pairs.op11,
    "op12_vector_codes": vector_codes.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

ORACLE_SQL = {
    "op1_media_columns": sql.OP1,
    "op3_mixing": sql.OP3,
    "op4_line_dedup": sql.OP4,
    "op6_substring_dedup": sql.OP6,
    "op8_chat_format": sql.OP8,
    "op10_near_dedup": sql.OP10,
    "op12_vector_codes": sql.OP12,
    "op13_periodic_runs": sql.OP13,
}
