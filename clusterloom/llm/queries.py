"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from clusterloom.llm import decontaminate, line_dedup, ngram_join, packing, quality_model, quality_rules, token_counts, token_store, url_filters, warc


def queries() -> dict:
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_packing": packing.query,
        "op3_warc": warc.query,
        "op4_token_counts": token_counts.query,
        "op5_ngram_join": ngram_join.query,
        "op6_url_filters": url_filters.query,
        "op7_quality_model": quality_model.query,
        "op8_line_dedup": line_dedup.query,
        "op9_decontamination": decontaminate.query,
        "op10_token_store": token_store.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_rules.SQL,
        "op3_warc": warc.SQL,
        "op6_url_filters": url_filters.SQL,
    }
