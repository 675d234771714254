"""The corpus pipeline: documents to packed training windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from entloom.llm import op1_secrets, op3_packing, op5_language, op6_neardup, op7_mixing
from entloom.llm.store import Store
from entloom.sources.documents import spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", op5_language.stage),
    ("near_dedup", op6_neardup.stage),
    ("secret_scan", op1_secrets.stage),
    ("mixing", op7_mixing.stage),
    ("packing", op3_packing.stage),
]

#: Networks, sampling and packing aren't SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    store = Store(spark, "pipeline")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (name, stage) in enumerate(STAGES):
        docs = store.keep(stage(spark, docs, sf_dir), f"{k}-{name}")
        if k:
            store.drop(f"{k - 1}-{STAGES[k - 1][0]}")
    return docs
