"""Queries of this subpackage, one for each operator, and their SQL where there is one."""

from __future__ import annotations

from . import ann_graph, byte_bpe, html_extract, lm_scoring, packing, pu_quality, quality_rules, simhash, token_counts, tool_chat

QUERIES = {
    "op1_lm_score": lm_scoring.op1_lm_score,
    "op2_simhash": simhash.op2_simhash,
    "op3_html_extract": html_extract.op3_html_extract,
    "op4_tool_chat": tool_chat.op4_tool_chat,
    "op5_pack": packing.op5_pack,
    "op6_pu_quality": pu_quality.op6_pu_quality,
    "op7_quality_rules": quality_rules.op7_quality_rules,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_graph_search": ann_graph.op10_graph_search,
}

ORACLE_SQL = {"op4_tool_chat": tool_chat.OP4_SQL}
