"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontamination, embedding_dedup, fill_in_middle, language_id, line_dedup, mixing, pii, run_index, simhash, substring_dedup, toxicity, vector_codes, warc

QUERIES = {
    "op1_pii": pii.query,
    "op2_line_dedup": line_dedup.query,
    "op3_simhash": simhash.query,
    "op4_decontamination": decontamination.query,
    "op5_toxicity": toxicity.query,
    "op6_mixing": mixing.query,
    "op7_language_id": language_id.query,
    "op8_warc_revisits": warc.query,
    "op9_embedding_dedup": embedding_dedup.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_vector_codes": vector_codes.query,
    "op12_fill_in_middle": fill_in_middle.query,
    "op13_run_index": run_index.query,
}
SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op8_warc_revisits": warc.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
    "op10_substring_dedup": substring_dedup.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_fill_in_middle": fill_in_middle.SQL,
    "op13_run_index": run_index.SQL,
}
