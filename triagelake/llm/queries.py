"""The subpackage's registered queries and their SQL."""

from __future__ import annotations

from triagelake.llm import chat_format, decontam, hard_negatives, html_extract, line_dedup, phrases, pii, piece_codec, quality_ledger, simhash_dedup, substring_dedup, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_line_dedup": line_dedup.op3_line_dedup,
        "op4_html_extraction": html_extract.op4_html_extraction,
        "op5_simhash_dedup": simhash_dedup.op5_simhash_dedup,
        "op6_decontamination": decontam.op6_decontamination,
        "op7_pii": pii.op7_pii,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_quality_ledger": quality_ledger.op9_quality_ledger,
        "op10_piece_codec": piece_codec.op10_piece_codec,
        "op11_phrases": phrases.op11_phrases,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_chat_format": chat_format.op13_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_line_dedup": line_dedup.SQL,
        "op9_quality_ledger": quality_ledger.SQL,
        "op11_phrases": phrases.SQL,
        "op12_hard_negatives": hard_negatives.SQL,
        "op13_chat_format": chat_format.SQL,
    }
