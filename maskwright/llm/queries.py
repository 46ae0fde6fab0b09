"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from maskwright.llm import bpe, chat, filter_audit, fingerprint, html_text, langid, mixing, near_dedup, packing, repair, secrets, toxicity, vptree


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "pipeline": corpus_pipeline.run,
        "op1_packing": packing.op1_packing,
        "op2_secrets": secrets.op2_secrets,
        "op3_language": langid.op3_language,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_html_text": html_text.op5_html_text,
        "op6_nearest": vptree.op6_nearest,
        "op7_near_dedup": near_dedup.op7_near_dedup,
        "op8_chat_format": chat.op8_chat_format,
        "op9_fingerprint": fingerprint.op9_fingerprint,
        "op10_mixing": mixing.op10_mixing,
        "op11_repair": repair.op11_repair,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_bpe": bpe.op13_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_chat_format": chat.ORACLE_SQL, "op11_repair": repair.ORACLE_SQL, "op12_filter_audit": filter_audit.ORACLE_SQL}
