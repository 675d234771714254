"""End-to-end runs over a work folder."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backends import CorefClient, Embedder, Extractor, HashedEmbedder, TieBreaker
from ..operators import centroids as cn
from ..operators import cluster as cl
from ..operators import coref, embed, extract, review
from ..operators.incremental import resolve_incremental
from ..schema import EntitySchema
from ..sources.workdir import Workdir, read_review, write_review

CLUSTER_THRESHOLD, SPAN_THRESHOLD = 0.7, 0.5


@dataclass
class Run:
    workdir: Workdir
    schema: EntitySchema
    entities: DataFrame
    registry: DataFrame
    flagged: DataFrame
    manifest: dict


def extract_entities(docs: DataFrame, schema: EntitySchema, extractor: Extractor | None = None, coref_client: CorefClient | None = None, threshold: float = 0.4, template: str = "{name}") -> DataFrame:
    """Documents to entities of each document; without backends, by rules, the types' examples and equal surfaces."""
    if extractor is None:
        raw = extract.label_types(extract.extract_rules(docs, extract.RULES + extract.NAME_RULES), schema)
        if examples := [(t.name, e, 0.95) for t in schema.types for e in t.examples]:
            names = docs.sparkSession.createDataFrame(examples, "label string, name string, score double")
            raw = raw.unionByName(extract.label_types(extract.extract_gazetteer(docs, names, 0.95), schema))
    else:
        raw = extract.label_types(extract.extract_with(docs, schema, extractor).filter(F.col("score") >= threshold), schema, template)
    mentions = extract.mentions(extract.snap(raw, docs))
    groups = coref.same_surface_groups(mentions) if coref_client is None else coref.client_groups(mentions, docs, schema, coref_client)
    return coref.entities(groups, mentions)


def _routed(work: Workdir, entities: DataFrame, docs: DataFrame, schema: EntitySchema, cluster_threshold: float, span_threshold: float, only_flagged: bool) -> DataFrame:
    flagged = work.save(coref.route(entities, cluster_threshold, span_threshold), "flagged")
    lines = review.review_lines(entities, flagged, only_flagged)
    write_review(review.to_jsonl(lines, review.header(docs, schema.version)), work.path("review"))
    return flagged


def run(
    spark: SparkSession, docs: DataFrame, schema: EntitySchema, root: str | Path, extractor: Extractor | None = None, coref_client: CorefClient | None = None, tiebreaker: TieBreaker | None = None, embedder: Embedder | None = None,
    merge: float = cl.MERGE, borderline: float = cl.BORDERLINE, threshold: float = 0.4, cluster_threshold: float = CLUSTER_THRESHOLD, span_threshold: float = SPAN_THRESHOLD, incremental_from: str | Path | None = None, only_flagged: bool = False,
) -> Run:
    """Extraction, resolution (against another run's registry with `incremental_from`), routing and review files."""
    work = Workdir(spark, root)
    work.save_schema(schema)
    docs = work.save(docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text"), "documents")
    entities = work.save(extract_entities(docs, schema, extractor, coref_client, threshold), "entities")
    entities, registry = resolve(work, schema, tiebreaker, embedder, merge, borderline, incremental_from)
    flagged = _routed(work, entities, docs, schema, cluster_threshold, span_threshold, only_flagged)
    manifest = work.write_manifest(schema, {"n_documents": docs.count(), "n_entities": entities.count(), "n_flagged": flagged.count()})
    return Run(work, schema, entities, registry, flagged, manifest)


def run_one(spark: SparkSession, doc_id: str, text: str, schema: EntitySchema, extractor: Extractor | None = None, coref_client: CorefClient | None = None, threshold: float = 0.4) -> DataFrame:
    """Entities of one document."""
    docs = spark.createDataFrame([(doc_id, text)], "doc_id string, text string")
    return extract_entities(docs, schema, extractor, coref_client, threshold)


def resolve(work: Workdir, schema: EntitySchema, tiebreaker: TieBreaker | None = None, embedder: Embedder | None = None, merge: float = cl.MERGE, borderline: float = cl.BORDERLINE, against: str | Path | None = None) -> tuple[DataFrame, DataFrame]:
    """Resolves a folder's entities and rewrites entities, registry and centroids. Vectors are made once, for both."""
    embedder = embedder or HashedEmbedder()
    docs, entities = work.load("documents"), work.load("entities")
    vectors = work.save(embed.embed(embed.representation(entities, docs), embedder).drop("repr"), "vectors")
    if against is None:
        found = cl.resolve(vectors, tiebreaker, docs, merge, borderline)
        tagged = work.save(cl.apply_assignments(vectors, found.assignments), "tagged")
        registry = work.save(cl.registry(tagged), "registry")
        work.save(cn.compute_centroids(tagged, embedder.model_id), "centroids")
    else:
        base = Workdir(work.spark, against)
        found = resolve_incremental(vectors, base.load("registry"), base.load("centroids"), embedder.model_id, tiebreaker, merge, borderline, docs)
        tagged, registry = found.entities, work.save(found.registry, "registry")
        work.save(found.centroids, "centroids")
    return work.save(tagged.drop("vector"), "entities"), registry


def rebuild_centroids(work: Workdir, embedder: Embedder | None = None) -> DataFrame:
    """Centroids of a folder whose registry has none."""
    embedder = embedder or HashedEmbedder()
    rows = embed.embed(embed.representation(work.load("entities"), work.load("documents")), embedder)
    return work.save(cn.compute_centroids(rows, embedder.model_id), "centroids")


def import_reviewed(work: Workdir, folder: str | Path | None = None, strict: bool = False) -> DataFrame:
    """Replays review files over the entities. `strict` refuses files with lint errors; the registry isn't touched."""
    headers, lines = read_review(work.spark, str(folder or work.path("review")))
    docs, rows = work.load("documents"), work.load("entities")
    if strict and (wrong := review.lint(lines, headers, docs, work.schema(), rows).head(5)):
        raise ValueError("review files have errors: " + "; ".join(f"{r.doc_id}:{r.line}: {r.message}" for r in wrong))
    known = lines.join(docs.select("doc_id"), "doc_id", "left_semi")
    return work.save(review.apply_review(rows, known, docs), "entities")


def inspect(entities: DataFrame, most: int = 20) -> DataFrame:
    """The entities with the most mentions, then the surest."""
    n = F.size("mentions").alias("n_mentions")
    return entities.select("doc_id", "entity_id", "type", "canonical", n, "confidence", "cluster_id").orderBy(F.desc("n_mentions"), F.desc("confidence"), "doc_id", "entity_id").limit(most)
