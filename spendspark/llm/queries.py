"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spendspark.llm import bpe, filter_audit, html_text, license_scan, media_copies, merkle, near_dedup, packing, pii, quality_rules, secrets, toxicity, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality_rules.op1,
        "op2_license_scan": license_scan.op2,
        "op3_secret_scan": secrets.op3,
        "op4_near_dedup": near_dedup.op4,
        "op5_url_filter": url_filter.op5,
        "op6_media_copies": media_copies.op6,
        "op7_html_text": html_text.op7,
        "op8_best_fit_packing": packing.op8,
        "op9_bpe_round_trip": bpe.op9,
        "op10_toxicity": toxicity.op10,
        "op11_filter_audit": filter_audit.op11,
        "op12_merkle_manifest": merkle.op12,
        "op13_personal_data": pii.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_dedup": near_dedup.SQL,
        "op5_url_filter": url_filter.SQL,
        "op11_filter_audit": filter_audit.SQL,
        "op12_merkle_manifest": merkle.SQL,
    }
