"""The queries of this subpackage, by name, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from folioforge.llm import bpe, decontaminate, html_text, imatch, licenses, line_dedup, simhash, toxicity, url_filter, warc

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_imatch": imatch.op2_imatch,
    "op3_warc": warc.op3_warc,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_line_dedup": line_dedup.op5_line_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_licenses": licenses.op9_licenses,
    "op10_byte_bpe": bpe.op10_byte_bpe,
}

ORACLE = {
    "op3_warc": warc.ORACLE,
    "op4_url_filter": url_filter.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
}
