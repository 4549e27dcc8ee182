"""Queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from . import conversations, decontaminate, exact_dedup, filter_audit, jaccard_join, licenses, packing, passages, personal, quality, suffix_dedup, token_files, toxicity

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_personal_data": personal.op2_personal_data,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality_classifier": quality.op4_quality_classifier,
    "op5_passages": passages.op5_passages,
    "op6_jaccard_join": jaccard_join.op6_jaccard_join,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_packing": packing.op8_packing,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op1_license_scan": licenses.ORACLE_SQL,
    "op3_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_jaccard_join": jaccard_join.ORACLE_SQL,
    "op9_suffix_dedup": suffix_dedup.ORACLE_SQL,
    "op10_decontaminate": decontaminate.ORACLE_SQL,
    "op11_conversation_repair": conversations.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
