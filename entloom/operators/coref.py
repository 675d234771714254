"""Mentions to entities of one document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..backends import CorefClient, checked_groups
from ..functions import ids, scores, tokens
from ..schema import EntitySchema

_GROUP_SCHEMA = "doc_id string, canonical string, type string, confidence double, mention_ids array<string>"
_GROUP_ARROW = pa.schema([("doc_id", pa.string()), ("canonical", pa.string()), ("type", pa.string()), ("confidence", pa.float64()), ("mention_ids", pa.list_(pa.string()))])


def unique(mentions: DataFrame) -> DataFrame:
    """Mentions with distinct ids. Ids leave the type out, so two types at one place share one; the later by type stays."""
    w = Window.partitionBy("doc_id", "id").orderBy(F.desc("type"))
    return mentions.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def same_surface_groups(mentions: DataFrame, confidence: float = 0.9) -> DataFrame:
    """Groups of the mentions of a document that have one type and one text, whatever its case; no Python."""
    longest = F.max_by("text", F.struct(F.length("text"), -F.col("start"), -F.col("end")))
    groups = unique(mentions).groupBy("doc_id", "type", F.lower("text").alias("group_key")).agg(longest.alias("canonical"), F.array_sort(F.collect_set("id")).alias("mention_ids"))
    return groups.select("doc_id", "canonical", "type", F.lit(confidence).alias("confidence"), "mention_ids")


def client_groups(mentions: DataFrame, docs: DataFrame, schema: EntitySchema, client: CorefClient) -> DataFrame:
    """Groups by a coreference client, called once for each document that has mentions; its answer is validated.

    A document's mentions and text are one row, so Python takes documents in Arrow
    batches; a data frame for each would cost more than most clients' work.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in tokens.pieces(batch.column(1)):
                out = []
                for doc_id, text, ms in zip(*(batch.column(c)[k].to_pylist() for c in range(3)), strict=True):
                    rows = [{"doc_id": doc_id, **m} for m in sorted(ms, key=lambda m: (m["start"], m["end"], m["type"], m["id"]))]
                    out += [(doc_id, g.canonical, g.type, g.confidence, list(g.mention_ids)) for g in checked_groups(client.group(doc_id, text, rows, schema), rows, schema)]
                columns = zip(*out, strict=True) if out else [()] * len(_GROUP_ARROW)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _GROUP_ARROW, strict=True)], schema=_GROUP_ARROW)

    listed = unique(mentions).groupBy("doc_id").agg(F.collect_list(F.struct("id", "start", "end", "text", "type", "score")).alias("ms"))
    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").dropDuplicates(["doc_id"])
    rows = listed.join(body, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "ms")
    return rows.mapInArrow(run, _GROUP_SCHEMA)


def partition_violations(groups: DataFrame, mentions: DataFrame, schema: EntitySchema) -> DataFrame:
    """(doc_id, id, problem) where groups aren't a partition of a document's mentions, or have an unknown type."""
    listed = groups.select("doc_id", F.explode("mention_ids").alias("id"))
    known = mentions.select("doc_id", "id").distinct()
    again = listed.groupBy("doc_id", "id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id", "id", F.lit("repeated").alias("problem"))
    unknown = listed.join(known, ["doc_id", "id"], "left_anti").select("doc_id", "id", F.lit("unknown").alias("problem"))
    missing = known.join(listed, ["doc_id", "id"], "left_anti").select("doc_id", "id", F.lit("missing").alias("problem"))
    types = groups.filter(~F.col("type").isin(schema.type_names)).select("doc_id", F.col("type").alias("id"), F.lit("type").alias("problem"))
    return again.union(unknown).union(missing).union(types).distinct()


def entities(groups: DataFrame, mentions: DataFrame) -> DataFrame:
    """Entity rows, with their mentions in document order.

    The surface is the longest mention text (the first on a tie).
    """
    by_id = unique(mentions).select("doc_id", "id", F.struct("id", "start", "end", "text", "type", "score", "source", F.lit(None).cast("string").alias("metadata")).alias("m"))
    listed = groups.withColumn("id", F.explode("mention_ids"))
    key = ["doc_id", "type", "canonical", "confidence", "mention_ids"]
    rows = listed.join(by_id, ["doc_id", "id"])
    found = rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct(F.col("m.start"), F.col("m.end"), F.col("m.id").alias("mid"), "m"))).alias("ms"),
        F.max_by("m.text", F.struct(F.length("m.text"), -F.col("m.start"), -F.col("m.end"))).alias("surface_canonical"),
        F.avg("m.score").alias("mean"),
    )
    return found.select(
        "doc_id", ids.entity_id(F.col("doc_id"), F.transform("ms", lambda x: x["mid"])).alias("entity_id"), "type", "canonical", "surface_canonical",
        scores.within_doc_confidence(F.col("mean"), F.col("confidence")).alias("confidence"), F.lit(None).cast("string").alias("cluster_id"), F.transform("ms", lambda x: x["m"]).alias("mentions"),
    )


def route(rows: DataFrame, sure_from: float = 0.7, span_from: float = 0.5) -> DataFrame:
    """(doc_id, entity_id, reason) of the entities that need a reviewer."""
    least = F.array_min(F.transform("mentions", lambda m: m["score"]))
    reason = scores.review_reason(F.col("confidence"), F.col("cluster_id"), least, sure_from, span_from)
    return rows.select("doc_id", "entity_id", reason.alias("reason")).filter("reason is not null")
