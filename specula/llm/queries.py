"""The registered queries of this subpackage and their SQL for the oracle."""

from __future__ import annotations

import corpus_pipeline
from specula.llm import byte_bpe, chat_format, decontaminate, exact_dedup, html_extract, language_id, line_dedup, near_dup, secret_scan, substring_dedup
from specula.llm.common import read


def queries():
    return {
        "pipeline": corpus_pipeline.run,
        "op1_html_extract": lambda spark, d: html_extract.op1_html_extract(read(spark, d, "pages")),
        "op10_secret_scan": lambda spark, d: secret_scan.op10_secret_scan(read(spark, d, "documents")),
        "op2_line_dedup": lambda spark, d: line_dedup.op2_line_dedup(read(spark, d, "documents")),
        "op3_byte_bpe": lambda spark, d: byte_bpe.op3_byte_bpe(read(spark, d, "documents")),
        "op4_exact_dedup": lambda spark, d: exact_dedup.op4_exact_dedup(read(spark, d, "documents")),
        "op5_decontaminate": lambda spark, d: decontaminate.op5_decontaminate(read(spark, d, "documents"), read(spark, d, "benchmark")),
        "op6_near_dup": lambda spark, d: near_dup.op6_near_dup(read(spark, d, "documents")),
        "op7_language_id": lambda spark, d: language_id.op7_language_id(read(spark, d, "documents")),
        "op8_substring_dedup": lambda spark, d: substring_dedup.op8_substring_dedup(read(spark, d, "documents")),
        "op9_chat_format": lambda spark, d: chat_format.op9_chat_format(read(spark, d, "conversations")),
    }


def oracle_sql():
    pipeline = {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}
    return pipeline | {"op2_line_dedup": line_dedup.OP2_SQL, "op4_exact_dedup": exact_dedup.OP4_SQL, "op5_decontaminate": decontaminate.OP5_SQL, "op6_near_dup": near_dup.OP6_SQL, "op8_substring_dedup": substring_dedup.OP8_SQL, "op9_chat_format": chat_format.OP9_SQL}
