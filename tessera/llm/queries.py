"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from tessera.llm import chat, decontaminate, lines, mixing, neardup, pii, secrets, substrings, topk, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op2_top_k": topk.op2_top_k,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_substring_dedup": substrings.op5_substring_dedup,
    "op6_line_dedup": lines.op6_line_dedup,
    "op7_chat_format": chat.op7_chat_format,
    "op8_near_duplicates": neardup.op8_near_duplicates,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_personal_data": pii.op10_personal_data,
}
SQL = {
    "op2_top_k": topk.OP2_SQL,
    "op5_substring_dedup": substrings.OP5_SQL,
    "op8_near_duplicates": neardup.OP8_SQL,
    "op6_line_dedup": lines.OP6_SQL,
    "op7_chat_format": chat.OP7_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
}
