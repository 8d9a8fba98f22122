"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, chat, decontaminate, fingerprints, html_extract, jaccard_join, secrets, substring, toxicity, urlfilter


def queries():
    return {
        "op1_byte_bpe": bpe.op1_byte_bpe,
        "op2_secret_scans": secrets.op2_secret_scans,
        "op3_ngram_jaccard_join": jaccard_join.op3_ngram_jaccard_join,
        "op4_benchmark_decontamination": decontaminate.op4_benchmark_decontamination,
        "op5_substring_dedup": substring.op5_substring_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
        "op8_html_extraction": html_extract.op8_html_extraction,
        "op9_chat_formatting": chat.op9_chat_formatting,
        "op10_url_filters": urlfilter.op10_url_filters,
    }


def oracle_sql():
    return {"op9_chat_formatting": chat.SQL, "op10_url_filters": urlfilter.SQL}
