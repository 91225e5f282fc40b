"""The queries of the subpackage and their SQL."""

from __future__ import annotations

from tarnlake.llm import bpe_segment, collocations, decontaminate, html_extract, line_dedup, lm_mixing, lsh_forest, quality_resample, quality_rules, secret_scan, token_align, token_store, toxicity


def queries():
    return {
        "op1_secret_scan": secret_scan.op1_secret_scan,
        "op2_quality_resample": quality_resample.op2_quality_resample,
        "op3_html_extract": html_extract.op3_html_extract,
        "op4_near_dedup": lsh_forest.op4_near_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_lm_mixing": lm_mixing.op6_lm_mixing,
        "op7_bpe_round_trip": bpe_segment.op7_bpe_round_trip,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_token_files": token_store.op9_token_files,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_collocations": collocations.op12_collocations,
        "op13_token_align": token_align.op13_token_align,
    }


def oracle_sql():
    return {
        "op4_near_dedup": lsh_forest.OP4_SQL,
        "op8_decontaminate": decontaminate.OP8_SQL,
        "op10_quality_rules": quality_rules.OP10_SQL,
        "op11_line_dedup": line_dedup.OP11_SQL,
        "op12_collocations": collocations.OP12_SQL,
    }
