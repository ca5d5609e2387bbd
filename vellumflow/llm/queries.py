"""Queries of this package and, where SQL can express them, the SQL for the same rows."""

from __future__ import annotations

from . import op1_line_dedup, op2_mix_sources, op3_pack_tokens, op4_exact_dedup, op5_simhash, op6_html_extract, op7_decontaminate, op8_toxicity, op9_language_id, op10_chat_format, op11_phrases, op12_warc, op13_prefix_trie

QUERIES = {
    "op1_line_dedup": op1_line_dedup.op1_line_dedup,
    "op2_mix_sources": op2_mix_sources.op2_mix_sources,
    "op3_pack_tokens": op3_pack_tokens.op3_pack_tokens,
    "op4_exact_dedup": op4_exact_dedup.op4_exact_dedup,
    "op5_simhash": op5_simhash.op5_simhash,
    "op6_html_extract": op6_html_extract.op6_html_extract,
    "op7_decontaminate": op7_decontaminate.op7_decontaminate,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_language_id": op9_language_id.op9_language_id,
    "op10_chat_format": op10_chat_format.op10_chat_format,
    "op11_phrases": op11_phrases.op11_phrases,
    "op12_warc": op12_warc.op12_warc,
    "op13_prefix_trie": op13_prefix_trie.op13_prefix_trie,
}

SQL = {
    "op4_exact_dedup": op4_exact_dedup.SQL,
    "op10_chat_format": op10_chat_format.SQL,
    "op11_phrases": op11_phrases.SQL,
    "op12_warc": op12_warc.SQL,
    "op13_prefix_trie": op13_prefix_trie.SQL,
}
