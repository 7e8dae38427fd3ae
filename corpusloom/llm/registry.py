"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from . import chroma, decontamination, exact_dedup, html_extract, lexical_search, line_dedup, mixing, packing, simhash, suffix_dedup, toxicity, url_filter, vector_codes


def queries():
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_chroma": chroma.op2_chroma,
        "op3_exact_dedup": exact_dedup.op3_exact_dedup,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_packing": packing.op5_packing,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_simhash": simhash.op10_simhash,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_decontamination": decontamination.op12_decontamination,
        "op13_vector_codes": vector_codes.op13_vector_codes,
    }


def oracle_sql():
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op3_exact_dedup": exact_dedup.OP3_SQL,
        "op7_url_filter": url_filter.op7_sql(),
        "op11_lexical_search": lexical_search.OP11_SQL,
        "op12_decontamination": decontamination.OP12_SQL,
        "op13_vector_codes": vector_codes.OP13_SQL,
    }
