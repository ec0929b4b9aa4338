"""The registered queries of this package and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from textloom.llm import decontamination, hard_negatives, language_id, lexical_search, line_dedup, minhash, mixing, quality_classifier, quality_rules, sharding, suffix_dedup, url_filter, warc

Q = {
    "op1_warc": warc.op1_warc,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_language_id": language_id.op3_language_id,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_mixing": mixing.op9_mixing,
    "op10_minhash": minhash.op10_minhash,
    "op11_lexical_search": lexical_search.op11_lexical_search,
    "op12_sharding": sharding.op12_sharding,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

SQL = {
    "op1_warc": warc.OP1_SQL,
    "op2_line_dedup": line_dedup.OP2_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_lexical_search": lexical_search.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
