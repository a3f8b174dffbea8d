"""The queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from . import bpe, collocations, hard_negatives, html_text, imatch, line_dedup, near_dedup, packing, secrets, substring_dedup, token_count, toxicity, vector_search

QUERIES = {
    "op1_imatch": imatch.op1_imatch,
    "op2_html_text": html_text.op2_html_text,
    "op3_vector_search": vector_search.op3_vector_search,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_token_counts": token_count.op6_token_counts,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_near_dedup": near_dedup.op8_near_dedup,
    "op9_secrets": secrets.op9_secrets,
    "op10_packing": packing.op10_packing,
    "op11_line_dedup": line_dedup.op11_line_dedup,
    "op12_collocations": collocations.op12_collocations,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE: dict[str, str] = {"op11_line_dedup": line_dedup.SQL, "op12_collocations": collocations.SQL, "op13_hard_negatives": hard_negatives.SQL}
