"""The queries of the training-data operators, and their SQL where there is any."""

from __future__ import annotations

from corpusloom.llm import bpe, chat, crf, exact_dedup, katz, line_dedup, mixing, quality_rules, simhash, url_filters
from corpusloom.llm.common import read

QUERIES = {
    "op1_chat_formatting": lambda spark, d: chat.report(read(spark, d, "conversations")),
    "op2_quality_rules": lambda spark, d: quality_rules.report(read(spark, d, "documents")),
    "op3_exact_dedup": lambda spark, d: exact_dedup.report(read(spark, d, "documents")),
    "op4_quality_classifier": lambda spark, d: crf.report(read(spark, d, "documents"), read(spark, d, "labels")),
    "op5_byte_bpe": lambda spark, d: bpe.report(read(spark, d, "documents")),
    "op6_line_dedup": lambda spark, d: line_dedup.report(read(spark, d, "documents")),
    "op7_url_filters": lambda spark, d: url_filters.report(read(spark, d, "pages")),
    "op8_lm_scoring": lambda spark, d: katz.report(read(spark, d, "documents")),
    "op9_simhash": lambda spark, d: simhash.report(read(spark, d, "documents")),
    "op10_mixing": lambda spark, d: mixing.mixing_report(read(spark, d, "documents")),
}

ORACLE_SQL = {
    "op1_chat_formatting": chat.SQL,
    "op2_quality_rules": quality_rules.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_url_filters": url_filters.SQL,
    "op10_mixing": mixing.SQL,
}
