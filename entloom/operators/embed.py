"""Entities to text and to vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..backends import Embedder
from ..functions import text


def contexts(mentions: Column, body: Column, most: int, half: int) -> Column:
    """Windows around the first mentions."""
    return F.transform(F.slice(mentions, 1, most), lambda m: text.context(body, m["start"], m["end"], half))


def representation(rows: DataFrame, docs: DataFrame | None, most: int = 2, half: int = 80) -> DataFrame:
    """`repr`: the canonical name and, given the documents, the contexts of the first mentions."""
    if docs is None:
        return rows.withColumn("repr", F.col("canonical"))
    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__body"))
    found = F.filter(contexts(F.col("mentions"), F.col("__body"), most, half), lambda c: c != "")
    return rows.join(body, "doc_id", "left").withColumn("repr", F.concat_ws(" | ", F.array("canonical"), F.coalesce(found, F.array().cast("array<string>")))).drop("__body")


def embed(rows: DataFrame, embedder: Embedder, column: str = "repr", vector: str = "vector") -> DataFrame:
    """`vector` by a backend, in Arrow batches; the model is loaded once in a Python worker."""

    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([v.astype(float).tolist() for v in embedder.encode(texts.fillna("").tolist())], dtype=object)

    return rows.withColumn(vector, encode(F.col(column)))
