"""Queries of this folder by name, and their DuckDB SQL where there is one."""

from __future__ import annotations

from textloom.llm import bpe, chat, langid, mixing, pii, quality, sharding, simhash, topk, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_mixing": mixing.op2_mixing,
    "op3_simhash": simhash.op3_simhash,
    "op4_pii": pii.op4_pii,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_chat_formatting": chat.op6_chat_formatting,
    "op7_sharding": sharding.op7_sharding,
    "op8_language_id": langid.op8_language_id,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_topk": topk.op10_topk,
}
SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op6_chat_formatting": chat.OP6_SQL,
    "op9_quality_rules": quality.OP9_SQL,
    "op10_topk": topk.OP10_SQL,
}
