"""The queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, chat, language_id, license_scan, neighbours, packing, quality_classifier, quality_rules, simhash, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.query,
    "op2_chat": chat.query,
    "op3_language_id": language_id.query,
    "op4_neighbours": neighbours.query,
    "op5_token_counts": token_counts.query,
    "op6_quality_rules": quality_rules.query,
    "op7_quality_classifier": quality_classifier.query,
    "op8_packing": packing.query,
    "op9_simhash": simhash.query,
    "op10_license_scan": license_scan.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_chat": chat.ORACLE,
}
