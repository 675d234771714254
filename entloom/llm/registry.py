"""Queries of the training-data operators, and DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_secrets, op2_quality, op3_packing, op4_urls, op5_language, op6_neardup, op7_mixing, op8_rules, op9_licences, op10_media

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secrets.query,
    "op2_quality_classifier": op2_quality.query,
    "op3_packing": op3_packing.query,
    "op4_url_filter": op4_urls.query,
    "op5_language_id": op5_language.query,
    "op6_minhash_near_dedup": op6_neardup.query,
    "op7_mixing": op7_mixing.query,
    "op8_quality_rules": op8_rules.query,
    "op9_license_scan": op9_licences.query,
    "op10_media_columns": op10_media.query,
}

ORACLE_SQL: dict[str, str] = {
    "op1_secret_scan": op1_secrets.SQL,
    "op6_minhash_near_dedup": op6_neardup.SQL,
    "op7_mixing": op7_mixing.SQL,
    "op8_quality_rules": op8_rules.SQL,
    "op9_license_scan": op9_licences.SQL,
}
