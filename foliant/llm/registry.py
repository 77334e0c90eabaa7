"""Queries of this subpackage by name, and their SQL equivalents where SQL has them."""

from . import arc_convert, chat_format, decontaminate, line_dedup, lm_scoring, near_dedup, ordinal_quality, quality_rules, source_mixing, token_counts

QUERIES = {
    "op1_arc_to_warc": arc_convert.op1_arc_to_warc,
    "op2_chat_formatting": chat_format.op2_chat_formatting,
    "op3_benchmark_decontamination": decontaminate.op3_benchmark_decontamination,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_ordinal_quality": ordinal_quality.op5_ordinal_quality,
    "op6_source_mixing": source_mixing.op6_source_mixing,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

ORACLES = {
    "op1_arc_to_warc": arc_convert.ORACLE,
    "op2_chat_formatting": chat_format.ORACLE,
    "op8_minhash_near_dedup": near_dedup.ORACLE,
}
