"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from lexiflow.llm import decontaminate, language, licences, lines, minhash, mixing, passages, quality, rules, suffixes

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_minhash": minhash.op3_minhash,
    "op4_line_dedup": lines.op4_line_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_license_scan": licences.op6_license_scan,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_suffix_dedup": suffixes.op8_suffix_dedup,
    "op9_language_id": language.op9_language_id,
    "op10_substring_dedup": passages.op10_substring_dedup,
}
SQL = {
    "op2_decontaminate": decontaminate.OP2_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op7_quality_rules": rules.OP7_SQL,
    "op8_suffix_dedup": suffixes.OP8_SQL,
    "op10_substring_dedup": passages.OP10_SQL,
}
