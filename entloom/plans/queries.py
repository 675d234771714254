"""One query for each operator, over the driver's tables; SQL that says the same is in :mod:`.oracle`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..backends import FirstWordCoref, HashedEmbedder, NearestTieBreaker
from ..functions import ids, scores, text
from ..operators import centroids as cn
from ..operators import cluster as cl
from ..operators import coref, embed, evaluate, extract, incremental, review
from ..operators.components import components
from ..operators.similarity import similar_links, similar_pairs
from ..schema import EntitySchema, EntityType
from ..sources.documents import spread
from . import pipeline

MERGE, BORDERLINE, TIEBREAK = 0.40, 0.35, 0.36
SWEEP_MERGE, SWEEP_BORDERLINE = (0.40, 0.42, 0.45), (0.35, 0.40, 0.44)
SCHEMA = EntitySchema(tuple(EntityType(n, d) for n, d in (("Email", "An e-mail address"), ("IPv4", "A network address"), ("License", "The name of a licence"), ("Phone", "A telephone or card number"), ("ProperName", "Capitalised words"))))


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spread(spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text"))


def _raw(spark: SparkSession, d: str) -> DataFrame:
    return extract.label_types(extract.extract_rules(_docs(spark, d)), SCHEMA)


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    return extract.mentions(_raw(spark, d))


def _entities(spark: SparkSession, d: str) -> DataFrame:
    m = _mentions(spark, d)
    return coref.entities(coref.same_surface_groups(m), m)


def _vectors(spark: SparkSession, d: str, kind=None) -> DataFrame:
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    name = F.concat(F.lit("v"), F.col("vec_id").cast("string"))
    return v.select(
        F.col("vec_id").cast("string").alias("doc_id"), name.alias("entity_id"), (F.lit("Vector") if kind is None else kind).alias("type"), name.alias("canonical"), name.alias("surface_canonical"),
        (0.8 + 0.01 * (F.col("vec_id") % 10)).alias("confidence"), F.lit(None).cast("string").alias("cluster_id"), F.col("embedding").cast("array<double>").alias("vector"), F.col("vec_id").alias("ord"), "label",
    )


def _resolved(spark: SparkSession, d: str, tiebreak: bool = False) -> cl.Resolution:
    return cl.resolve(_vectors(spark, d), NearestTieBreaker(TIEBREAK) if tiebreak else None, None, MERGE, BORDERLINE)


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return cl.apply_assignments(_vectors(spark, d), _resolved(spark, d).assignments)


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select("doc_id", "entity_id", F.concat(F.lit("g"), F.col("label").cast("string")).alias("gold_cluster_id"))


def doc_scan_sha(spark, d):
    return _docs(spark, d).select("doc_id", ids.text_sha(F.col("text")).alias("text_sha"), F.length("text").alias("n"))


def safe_filename(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", ids.safe_filename(F.col("url")).alias("name"))


def token_counts(spark, d):
    return _docs(spark, d).select("doc_id", text.token_count(F.col("text")).alias("n_tokens"))


def token_offsets(spark, d):
    return extract.token_offsets(_docs(spark, d))


def mentions_regex(spark, d):
    return _raw(spark, d).select("doc_id", "start", "end", "text", "type", "score")


def unknown_labels(spark, d):
    few = EntitySchema(SCHEMA.types[:2])
    return extract.unknown_labels(extract.extract_rules(_docs(spark, d)), few)


def mention_ids(spark, d):
    m = _raw(spark, d)
    of = lambda source: ids.mention_id(F.col("doc_id"), F.col("start"), F.col("end"), F.lit(source))
    return m.select("doc_id", "start", "end", "type", of("regex").alias("id"), of("human").alias("human_id"))


def snap_mentions(spark, d):
    """Spans cut by a character at each end, brought back to whole tokens."""
    cut = _raw(spark, d).filter("end - start > 3").withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") - 1)
    return extract.snap(cut, _docs(spark, d)).select("doc_id", "start", "end", "text", "type", "score")


def nms_mentions(spark, d):
    return _mentions(spark, d).select("doc_id", "id", "start", "end", "type", "score")


def multilabel_overlaps(spark, d):
    return extract.type_overlaps(_mentions(spark, d))


def span_invariant_violations(spark, d):
    return extract.span_violations(_mentions(spark, d), _docs(spark, d)).select("doc_id", "id", "start", "end")


def span_invariant_violations_seeded(spark, d):
    """Every span whose start is even is moved by one; most of these no longer fit."""
    moved = _mentions(spark, d).withColumn("by", (F.col("start") % 2 == 0).cast("int"))
    moved = moved.withColumn("start", F.col("start") + F.col("by")).withColumn("end", F.col("end") + F.col("by"))
    return extract.span_violations(moved, _docs(spark, d)).select("doc_id", "id", "start", "end")


def gazetteer_mentions(spark, d):
    """Names of a table found in documents: the surfaces of all proper names of the corpus, looked up in it again."""
    names = _mentions(spark, d).filter("type = 'ProperName'").select(F.col("type").alias("label"), F.col("text").alias("name")).distinct()
    return extract.extract_gazetteer(_docs(spark, d), names).select("doc_id", "start", "end", "text", "label")


def coref_entities(spark, d):
    e = _entities(spark, d)
    return e.select("doc_id", "entity_id", "type", "canonical", F.size("mentions").alias("n_mentions"), F.get("mentions", F.lit(0))["start"].alias("first_start"))


def coref_client(spark, d):
    """Groups by a client in Python."""
    m = _mentions(spark, d)
    return coref.client_groups(m, _docs(spark, d), SCHEMA, FirstWordCoref()).select("doc_id", "type", "canonical", "confidence", F.size("mention_ids").alias("n_mentions"))


def surface_canonical(spark, d):
    return _entities(spark, d).select("doc_id", "entity_id", "surface_canonical")


def within_doc_conf(spark, d):
    return _entities(spark, d).select("doc_id", "entity_id", F.round("confidence", 6).alias("confidence"))


def partition_violations(spark, d):
    """Groups with one mention left out of each, and another listed twice where there are two."""
    m = _mentions(spark, d)
    g = coref.same_surface_groups(m).filter("type <> 'License'")
    g = g.withColumn("mention_ids", F.when(F.size("mention_ids") > 1, F.concat(F.slice("mention_ids", 2, 1000000), F.slice("mention_ids", 2, 1))).otherwise(F.col("mention_ids")))
    return coref.partition_violations(g, m, EntitySchema(SCHEMA.types[1:]))


def entity_repr(spark, d):
    return embed.representation(_entities(spark, d), _docs(spark, d)).select("doc_id", "entity_id", "repr")


def context_windows(spark, d):
    m = _mentions(spark, d).join(_docs(spark, d).withColumnRenamed("text", "body"), "doc_id")
    return m.select("doc_id", "start", "end", "type", text.context(F.col("body"), F.col("start"), F.col("end"), 60).alias("context"))


def embedded_entities(spark, d):
    """Entities with vectors by the local embedder."""
    e = embed.embed(embed.representation(_entities(spark, d), _docs(spark, d)), HashedEmbedder())
    return e.select("doc_id", "entity_id", F.size("vector").alias("dim"), F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x), 3).alias("norm2"))


def _numeric(spark, d, kind):
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector"), kind.alias("type"))


def sim_pairs(spark, d):
    return similar_pairs(_numeric(spark, d, F.lit("Vector")), MERGE).select("a", "b", F.round("similarity", 6).alias("similarity"))


def sim_pairs_blocked(spark, d):
    """Only within a label."""
    return similar_pairs(_numeric(spark, d, F.col("label").cast("string")), 0.3).select("type", "a", "b", F.round("similarity", 6).alias("similarity"))


def component_roots(spark, d):
    return components(similar_links(_numeric(spark, d, F.lit("Vector")), [MERGE])).select("node", "root")


def cluster_ids(spark, d):
    return _resolved(spark, d).clusters.select("cluster_id", "canonical", "n")


def singletons(spark, d):
    return _resolved(spark, d).assignments.filter("source = 'singleton'").select("doc_id", "entity_id", "cluster_id")


def loo_margin(spark, d):
    a = _resolved(spark, d).assignments.filter("source = 'threshold'")
    return a.select("doc_id", "entity_id", "cluster_id", F.round("top_similarity", 6).alias("top_similarity"), F.round("second_similarity", 6).alias("second_similarity"))


def nearest_cluster(spark, d):
    r = _resolved(spark, d)
    return r.candidates.select("doc_id", "entity_id", "nearest_cluster_id", F.round("nearest_similarity", 6).alias("nearest_similarity"))


def tiebreak_applied(spark, d):
    a = _resolved(spark, d, True).assignments.filter("source = 'llm_tiebreak'")
    return a.select("doc_id", "entity_id", "cluster_id", F.round("top_similarity", 6).alias("top_similarity"), F.round("second_similarity", 6).alias("second_similarity"))


def crossdoc_conf(spark, d):
    e = cl.apply_assignments(_vectors(spark, d), _resolved(spark, d, True).assignments)
    return e.select("doc_id", "entity_id", "cluster_id", F.round("confidence", 6).alias("confidence"))


def registry(spark, d):
    r = cl.registry(_tagged(spark, d))
    return r.select("cluster_id", "canonical", "type", F.array_join("members", ",").alias("members"))


def centroids(spark, d):
    c = cn.compute_centroids(_tagged(spark, d), "given")
    return c.select("cluster_id", "size", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "size", "dim", F.round("x", 6).alias("x"))


def _label_clusters(v: DataFrame) -> DataFrame:
    return v.withColumn("cluster_id", F.concat(F.lit("l"), F.col("label").cast("string")))


def centroids_updated(spark, d):
    """Centroids of the labels over even vectors, then the odd ones added: to clusters that are there, or as new ones."""
    v = _label_clusters(_vectors(spark, d))
    old = cn.compute_centroids(v.filter("ord % 2 = 0"), "given")
    odd = v.filter("ord % 2 = 1")
    new = cn.compute_centroids(odd.filter("label % 2 = 1").withColumn("cluster_id", F.concat(F.lit("new_"), "cluster_id")), "given")
    c = cn.update_centroids(old, odd.filter("label % 2 = 0").select("cluster_id", "vector"), new, "given")
    return c.select("cluster_id", "size", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", "size", "dim", F.round("x", 6).alias("x"))


def incremental_assign(spark, d):
    """Odd vectors against the registry of the even ones, in order."""
    v = _vectors(spark, d)
    old = cl.apply_assignments(v.filter("ord % 2 = 0"), cl.resolve(v.filter("ord % 2 = 0"), None, None, MERGE, BORDERLINE).assignments)
    found = incremental.assign(v.filter("ord % 2 = 1"), cn.compute_centroids(old, "given"), cl.registry(old), NearestTieBreaker(TIEBREAK), MERGE, BORDERLINE)
    return found.select("doc_id", "entity_id", "cluster_id", F.round("top_similarity", 6).alias("top_similarity"), "source", "is_new")


def review_route(spark, d):
    return coref.route(_entities(spark, d), 0.8, 0.5)


def review_lines(spark, d):
    e = _entities(spark, d)
    lines = review.review_lines(e, coref.route(e, 0.8, 0.5))
    return lines.select("doc_id", "line", "op", "id", "type", "canonical", F.round("confidence", 6).alias("confidence"), F.size("mentions").alias("n_mentions"), "reason")


def review_lines_flagged(spark, d):
    e = _entities(spark, d)
    return review.review_lines(e, coref.route(e, 0.8, 0.5), only_flagged=True).select("doc_id", "line", "id", "reason")


def _edited(e: DataFrame) -> DataFrame:
    """Lines with ops by the first digit of the id: 0-3 reject, 4-7 edit, 8-b keep; c-f aren't in the file."""
    digit = F.substring("id", 3, 1)
    lines = review.review_lines(e).filter(digit < "c")
    op = F.when(digit < "4", "reject").when(digit < "8", "edit").otherwise("keep")
    lines = lines.withColumn("op", op)
    return lines.withColumn("canonical", F.when(F.col("op") == "edit", F.concat("canonical", F.lit(" (edited)"))).otherwise(F.col("canonical")))


def review_apply(spark, d):
    e = _entities(spark, d)
    lines = _edited(e)
    add = lines.filter("line = 2").withColumn("op", F.lit("add")).withColumn("id", F.concat(F.lit("human_"), "id")).withColumn("line", F.lit(100000)).withColumn("confidence", F.lit(1.0))
    out = review.apply_review(e, lines.unionByName(add), _docs(spark, d))
    return out.select("doc_id", "entity_id", "type", "canonical", F.round("confidence", 6).alias("confidence"), F.size("mentions").alias("n_mentions"))


def review_lint(spark, d):
    """Lines spoilt by the first digit of the id: 0 twice there, 1 of no type, 2 another text, 3 out of bounds, 4 another id, 5 a bad added id."""
    e = _entities(spark, d)
    lines, digit = review.review_lines(e), F.substring("id", 3, 1)
    lines = lines.withColumn("digit", digit).withColumn("type", F.when(digit == "1", "Nope").otherwise(F.col("type")))
    lines = lines.withColumn("mentions", F.transform("mentions", lambda m: m.withField("text", F.when(F.col("digit") == "2", F.concat(m["text"], F.lit("?"))).otherwise(m["text"])).withField("end", F.when(F.col("digit") == "3", m["end"] + 10000000).otherwise(m["end"]))))
    lines = lines.withColumn("op", F.when(digit == "5", "add").otherwise(F.col("op"))).withColumn("id", F.when(digit == "4", F.concat("id", F.lit("x"))).otherwise(F.col("id")))
    lines = lines.unionByName(lines.filter("digit = '0'").withColumn("line", F.col("line") + 1000)).drop("digit")
    schema = EntitySchema(SCHEMA.types, "1")
    return review.lint(lines, None, _docs(spark, d), schema, e).distinct()


def review_lint_headers(spark, d):
    """Headers of another text and version for documents whose hash begins with a digit under 8."""
    docs = _docs(spark, d)
    h = review.header(docs, "1")
    stale = F.substring("text_sha", 1, 1) < "8"
    h = h.withColumn("schema_version", F.when(stale, "0").otherwise(F.col("schema_version"))).withColumn("text_sha", F.when(stale, "").otherwise(F.col("text_sha")))
    none = review.review_lines(_entities(spark, d)).filter("line < 0")
    return review.lint(none, h, docs, SCHEMA)


def _system(spark, d):
    return _tagged(spark, d).select("doc_id", "entity_id", "cluster_id")


def pairwise_prf(spark, d):
    p = evaluate.pairwise_prf(evaluate.contingency(_system(spark, d), _gold(spark, d)))
    return p.select(*[F.round(c, 9).alias(c) for c in p.columns])


def bcubed_prf(spark, d):
    p = evaluate.bcubed_prf(evaluate.contingency(_system(spark, d), _gold(spark, d)))
    return p.select(*[F.round(c, 9).alias(c) for c in p.columns])


def eval_report(spark, d):
    p = evaluate.evaluate(_system(spark, d), _gold(spark, d))
    return p.select(*[F.round(c, 9).alias(c) if c[:2] != "n_" else F.col(c) for c in p.columns])


def threshold_sweep(spark, d):
    p = evaluate.sweep_thresholds(_vectors(spark, d), _gold(spark, d), SWEEP_MERGE, SWEEP_BORDERLINE)
    return p.select("merge_threshold", "borderline_threshold", "n_system_clusters", *[F.round(c, 9).alias(c) for c in ("pairwise_f1", "bcubed_f1")])


def gold_duplicates(spark, d):
    """Gold with the rows of even vectors twice."""
    g = _gold(spark, d)
    return evaluate.gold_duplicates(g.union(g.filter(F.col("doc_id").cast("long") % 2 == 0)))


def inspect_topk(spark, d):
    """A report of the first twenty, as the command line shows it."""
    return pipeline.inspect(_entities(spark, d)).select("doc_id", "entity_id", "n_mentions", F.round("confidence", 6).alias("confidence"))


def manifest_counts(spark, d):
    e = _entities(spark, d)
    docs, flagged = _docs(spark, d), coref.route(e, 0.8, 0.5)
    return docs.agg(F.count("*").alias("n_documents")).crossJoin(e.agg(F.count("*").alias("n_entities"))).crossJoin(flagged.agg(F.count("*").alias("n_flagged")))


def confidence_formulas(spark, d):
    """The formulas over the values of a table."""
    e = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("x"), F.col("l_tax").alias("y"))
    return e.select("l_orderkey", "l_linenumber", F.round(scores.within_doc_confidence(F.col("x") * 10, F.col("y") * 20), 6).alias("within"), F.round(scores.crossdoc_confidence(F.col("x") * 10, F.lit(1.0), F.col("y") * 20, F.col("x")), 6).alias("cross"))


def extract_to_route(spark, d):
    """The flagship: documents to mentions, entities, confidences and review reasons in one plan, without Python."""
    e = _entities(spark, d)
    least = F.array_min(F.transform("mentions", lambda m: m["score"]))
    return e.select("doc_id", "entity_id", "type", "canonical", F.size("mentions").alias("n_mentions"), F.round("confidence", 6).alias("confidence"), scores.review_reason(F.col("confidence"), F.col("cluster_id"), least, 0.8, 0.5).alias("reason"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        extract_to_route, doc_scan_sha, safe_filename, token_counts, token_offsets, mentions_regex, unknown_labels, mention_ids, snap_mentions, nms_mentions, multilabel_overlaps, span_invariant_violations, span_invariant_violations_seeded, gazetteer_mentions,
        coref_entities, coref_client, surface_canonical, within_doc_conf, partition_violations, entity_repr, context_windows, embedded_entities, sim_pairs, sim_pairs_blocked, component_roots, cluster_ids, singletons, loo_margin, nearest_cluster, tiebreak_applied,
        crossdoc_conf, registry, centroids, centroids_updated, incremental_assign, review_route, review_lines, review_lines_flagged, review_apply, review_lint, review_lint_headers, pairwise_prf, bcubed_prf, eval_report, threshold_sweep, gold_duplicates, inspect_topk, manifest_counts,
        confidence_formulas,
    )
}
