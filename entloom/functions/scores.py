"""Confidence formulas and review reasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def within_doc_confidence(mean_score: Column, client: Column) -> Column:
    """Half the mean mention score, half the coreference client's own confidence."""
    return clamp(0.5 * mean_score + 0.5 * clamp(client))


def crossdoc_confidence(base: Column, decision: Column, top: Column, second: Column) -> Column:
    """Two fifths the entity's confidence, two fifths the decision's, one fifth the margin to the best rival."""
    return clamp(0.4 * base + 0.4 * decision + 0.2 * clamp(F.greatest(F.lit(0.0), top - second)))


def review_reason(confidence: Column, cluster_id: Column, least_score: Column, sure_from: float = 0.7, span_from: float = 0.5) -> Column:
    """Why an entity needs a reviewer; null if it doesn't."""
    unsure = F.when(cluster_id.isNotNull(), "ambiguous_merge").otherwise("low_cluster_conf")
    return F.when(confidence < sure_from, unsure).when(least_score < span_from, "low_span_conf")
