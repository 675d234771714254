"""Centroids of clusters, kept beside the registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors
from .cluster import vector_sums


def compute_centroids(rows: DataFrame, embedder_id: str) -> DataFrame:
    """(cluster_id, type, centroid, size, embedder_id): the unit mean of the vectors of each cluster's entities."""
    member = rows.filter("cluster_id is not null")
    kinds = member.groupBy("cluster_id").agg(F.max("type").alias("type"))
    sums = vector_sums(member, ["cluster_id"])
    mean = vectors.scaled(F.col("total"), 1 / F.col("n"))
    return sums.join(kinds, "cluster_id").select("cluster_id", "type", vectors.unit(mean).alias("centroid"), F.col("n").cast("int").alias("size"), F.lit(embedder_id).alias("embedder_id"))


def update_centroids(existing: DataFrame, additions: DataFrame, new: DataFrame, embedder_id: str) -> DataFrame:
    """Centroids after adding vectors (cluster_id, vector) to known clusters and clusters (as :func:`compute_centroids`) that are new.

    A size-weighted running mean, brought to unit length.  Reading the result is an
    error where the embedder differs, an addition's cluster isn't known, or a new
    cluster is.
    """
    sums = vector_sums(additions, ["cluster_id"]).withColumnRenamed("n", "k")
    e = existing.select("cluster_id", "type", "centroid", "size", F.col("embedder_id").alias("had"))
    both = e.join(sums, "cluster_id", "full")
    told = F.when(F.col("size").isNull(), F.concat(F.lit("addition to an unknown cluster "), F.col("cluster_id"))).when(F.col("had") != embedder_id, F.concat(F.lit("centroids are of embedder "), F.col("had")))
    both = both.filter(F.when(told.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    moved = vectors.scaled(vectors.plus(vectors.scaled(vectors.double(F.col("centroid")), F.col("size").cast("double")), F.col("total")), 1 / (F.col("size") + F.col("k")))
    kept = both.select("cluster_id", "type", F.when(F.col("k").isNull(), vectors.double(F.col("centroid"))).otherwise(vectors.unit(moved)).alias("centroid"), (F.col("size") + F.coalesce("k", F.lit(0))).cast("int").alias("size"), F.lit(embedder_id).alias("embedder_id"))
    known = existing.select("cluster_id", F.lit(True).alias("__known"))
    fresh = new.join(known, "cluster_id", "left")
    fresh = fresh.filter(F.when(F.col("__known"), F.raise_error(F.concat(F.lit("cluster is there already: "), F.col("cluster_id"))).cast("boolean")).otherwise(True))
    return kept.unionByName(fresh.select("cluster_id", "type", vectors.double(F.col("centroid")).alias("centroid"), F.col("size").cast("int").alias("size"), F.lit(embedder_id).alias("embedder_id")))
