"""Batch resolution of entities across documents."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..backends import TieBreaker, checked_merges
from ..functions import ids, scores, vectors
from ..store import Store
from .components import components
from .embed import contexts
from .similarity import best_two, similar_links

MERGE, BORDERLINE = 0.82, 0.75
TIEBREAK_CONFIDENCE = 0.9


@dataclass
class Resolution:
    """assignments: (doc_id, entity_id, cluster_id, top_similarity, second_similarity, source); clusters: (type, cluster_id, root, centroid, n)."""

    assignments: DataFrame
    clusters: DataFrame
    candidates: DataFrame


def numbered(rows: DataFrame) -> DataFrame:
    """`node`, and `rank`, the order in which entities are taken: by document, first mention, id.

    Where rows carry an `ord` of their own, that order is taken.
    """
    first = F.get("mentions", F.lit(0))["start"] if "mentions" in rows.columns else F.lit(0)
    order = F.struct(F.col("ord").cast("long").alias("o"), F.lit("").alias("d"), F.lit(0).alias("s"), F.lit("").alias("e")) if "ord" in rows.columns else F.struct(F.lit(0).cast("long").alias("o"), F.col("doc_id").alias("d"), F.coalesce(first, F.lit(0)).alias("s"), F.col("entity_id").alias("e"))
    return rows.withColumn("node", F.concat_ws("/", "doc_id", "entity_id")).withColumn("rank", order)


def vector_sums(rows: DataFrame, by: list[str], vector: str = "vector") -> DataFrame:
    """(by..., total, n): sums of vectors with partial aggregation in the JVM."""
    s = Summarizer.metrics("sum", "count").summary(array_to_vector(vectors.double(F.col(vector))))
    return rows.groupBy(*by).agg(s.alias("s")).select(*by, vector_to_array(F.col("s.sum")).alias("total"), F.col("s.count").alias("n"))



def _first_longest_window(by: list[str]):
    return F.row_number().over(Window.partitionBy(*by).orderBy(F.length("surface_canonical").desc(), "rank"))


def groups(rows: DataFrame, merge: float) -> DataFrame:
    """(node, root) of the entities that are at least as similar as `merge` to another of their type, directly or in a chain."""
    return components(similar_links(rows, [merge]))


def resolve(rows: DataFrame, tiebreaker: TieBreaker | None = None, docs: DataFrame | None = None, merge: float = MERGE, borderline: float = BORDERLINE) -> Resolution:
    """Clusters of entities with vectors of unit length.

    Entities of one type that are alike in a chain are a cluster, named by its
    longest surface.  The others go, if they come near enough to a cluster and the
    tie-breaker says so, to their nearest cluster, and are clusters of their own
    otherwise.
    """
    store = Store(rows.sparkSession, "resolve")
    keep = [*"doc_id entity_id type canonical surface_canonical confidence vector".split(), *(c for c in ("mentions", "ord") if c in rows.columns)]
    e = store.keep(numbered(rows.select(*keep)), "entities")
    root = store.keep(groups(e, merge), "roots")
    member = e.join(root, "node")

    named = member.withColumn("k", _first_longest_window(["type", "root"])).filter("k = 1").select("type", "root", F.col("surface_canonical").alias("name"))
    documents = member.groupBy("type", "root").agg(F.collect_set("doc_id").alias("ds"))
    sums = vector_sums(member, ["type", "root"])
    clusters = named.join(documents, ["type", "root"]).join(sums, ["type", "root"])
    clusters = clusters.select("type", "root", ids.cluster_id(F.col("type"), F.col("name"), F.col("ds")).alias("cluster_id"), F.col("name").alias("canonical"), "total", "n", vectors.unit(F.col("total")).alias("centroid"))
    clusters = store.keep(clusters, "clusters")

    # everything's best two clusters at once: rivals for members, nearest for the others
    placed = e.join(root, "node", "left")
    left = placed.select("type", "node", "vector", F.col("root").alias("own"))
    near = store.keep(best_two(left, clusters.select("type", F.col("root").alias("target"), F.col("centroid").alias("vector"))), "near")

    inside = placed.filter("root is not null").join(clusters.select("root", "cluster_id", "total"), "root").join(near, "node", "left")
    top = vectors.dot(vectors.double(F.col("vector")), vectors.unit(vectors.minus(F.col("total"), vectors.double(F.col("vector")))))
    inside = inside.select("doc_id", "entity_id", "cluster_id", top.alias("top_similarity"), F.greatest(F.lit(0.0), F.coalesce("first_similarity", F.lit(0.0))).alias("second_similarity"), F.lit("threshold").alias("source"))

    outside = placed.filter("root is null").join(near, "node", "left").join(clusters.select(F.col("root").alias("first"), F.col("cluster_id").alias("nearest_cluster_id"), F.col("canonical").alias("nearest_canonical")), "first", "left")
    outside = outside.withColumn("is_borderline", F.coalesce(F.col("first_similarity") >= borderline, F.lit(False)))
    candidates = store.keep(candidate_rows(outside.filter("is_borderline"), docs), "candidates")
    own = ids.cluster_id(F.col("type"), F.col("canonical"), F.array("doc_id"))
    single = outside.select("doc_id", "entity_id", own.alias("own_id"), "first_similarity", "second_similarity")
    if tiebreaker is not None:
        decided = tie_breaks(candidates, tiebreaker).filter("target_cluster_id is not null").select("doc_id", "entity_id", "target_cluster_id")
        single = single.join(decided, ["doc_id", "entity_id"], "left")
    else:
        single = single.withColumn("target_cluster_id", F.lit(None).cast("string"))
    moved = F.col("target_cluster_id").isNotNull()
    single = single.select(
        "doc_id", "entity_id", F.coalesce("target_cluster_id", "own_id").alias("cluster_id"), F.when(moved, F.col("first_similarity")).otherwise(1.0).alias("top_similarity"),
        F.when(moved, F.coalesce("second_similarity", F.lit(0.0))).otherwise(0.0).alias("second_similarity"), F.when(moved, "llm_tiebreak").otherwise("singleton").alias("source"),
    )
    return Resolution(inside.unionByName(single), clusters, candidates)


def with_contexts(rows: DataFrame, docs: DataFrame | None, most: int = 3, half: int = 60) -> DataFrame:
    """`contexts`: windows around an entity's first mentions, for a tie-breaker; none without documents or mentions."""
    empty = F.array().cast("array<string>")
    if docs is None or "mentions" not in rows.columns:
        return rows.withColumn("contexts", empty)
    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__body"))
    return rows.join(body, "doc_id", "left").withColumn("contexts", F.coalesce(contexts(F.col("mentions"), F.col("__body"), most, half), empty)).drop("__body")


def candidate_rows(outside: DataFrame, docs: DataFrame | None) -> DataFrame:
    """Borderline entities with contexts, for the tie-breaker."""
    outside = with_contexts(outside, docs)
    return outside.select("doc_id", "entity_id", "type", "canonical", "contexts", "nearest_cluster_id", "nearest_canonical", F.col("first_similarity").alias("nearest_similarity"))


def tie_breaks(candidates: DataFrame, tiebreaker: TieBreaker) -> DataFrame:
    """(doc_id, entity_id, target_cluster_id, confidence, rationale); the tie-breaker is called once for each type."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["doc_id", "entity_id"]).to_dict("records")
        refs = {f"{r['doc_id']}/{r['entity_id']}": r for r in rows}
        asked = [{**{k: r[k] for k in ("canonical", "type", "nearest_cluster_id", "nearest_similarity")}, "contexts": list(r["contexts"]), "entity_id": ref} for ref, r in refs.items()]
        clusters = {r["nearest_cluster_id"]: r["nearest_canonical"] for r in rows}
        found = checked_merges(tiebreaker.decide(asked, clusters), list(refs), clusters)
        return pd.DataFrame([(refs[m.entity_id]["doc_id"], refs[m.entity_id]["entity_id"], m.target, m.confidence, m.rationale) for m in found], columns=["doc_id", "entity_id", "target_cluster_id", "confidence", "rationale"])

    return candidates.groupBy("type").applyInPandas(run, "doc_id string, entity_id string, target_cluster_id string, confidence double, rationale string")


def apply_assignments(rows: DataFrame, assignments: DataFrame, decision: float = TIEBREAK_CONFIDENCE) -> DataFrame:
    """Entities with cluster_id and confidence set; those without an assignment stay as they are."""
    a = assignments.select("doc_id", "entity_id", F.col("cluster_id").alias("__c"), "top_similarity", "second_similarity", F.col("source").alias("__s"))
    found = rows.join(a, ["doc_id", "entity_id"], "left")
    sure = F.when(F.col("__s") == "llm_tiebreak", decision).otherwise(1.0)
    new = scores.crossdoc_confidence(F.col("confidence"), sure, F.col("top_similarity"), F.col("second_similarity"))
    found = found.withColumn("confidence", F.when(F.col("__c").isNotNull(), new).otherwise(F.col("confidence"))).withColumn("cluster_id", F.coalesce("__c", "cluster_id"))
    return found.select(*rows.columns)


def registry(rows: DataFrame) -> DataFrame:
    """(cluster_id, canonical, type, members): members in order, the longest surface (first on a tie), the last member's type."""
    e = numbered(rows.filter("cluster_id is not null"))
    found = e.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.col("node").alias("node")))).alias("ms"),
        F.min(F.struct((-F.length("surface_canonical")).alias("k"), "rank", F.col("surface_canonical").alias("s"))).alias("best"),
        F.max(F.struct("rank", "type")).alias("last"),
    )
    return found.select("cluster_id", F.col("best.s").alias("canonical"), F.col("last.type").alias("type"), F.transform("ms", lambda m: m["node"]).alias("members"))
