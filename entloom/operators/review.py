"""Human review: lines out, checks, and replay of the lines that come back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..model import MENTION, REVIEW_FORMAT, REVIEW_OPS
from ..schema import EntitySchema
from ..store import Store

_FIELDS = "type canonical surface_canonical confidence".split()
_MENTION_SQL = MENTION.simpleString()


def header(docs: DataFrame, schema_version: str) -> DataFrame:
    """(doc_id, format, text_sha, schema_version) of each document."""
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(REVIEW_FORMAT).alias("format"), ids.text_sha(F.col("text")).alias("text_sha"), F.lit(schema_version).alias("schema_version"))


def review_lines(rows: DataFrame, flags: DataFrame | None = None, only_flagged: bool = False) -> DataFrame:
    """A `keep` line for each entity, numbered within its document by first mention and id.

    With `flags` (doc_id, entity_id, reason) lines carry their reason; with
    `only_flagged` the others are left out.
    """
    if flags is None:
        rows = rows.withColumn("reason", F.lit(None).cast("string"))
    else:
        rows = rows.join(flags.select("doc_id", "entity_id", "reason"), ["doc_id", "entity_id"], "inner" if only_flagged else "left")
    first = F.get("mentions", F.lit(0))["start"]
    line = F.row_number().over(Window.partitionBy("doc_id").orderBy(first, "entity_id")) + 1
    flat = F.transform("mentions", lambda m: F.struct(m["id"].alias("id"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), m["score"].alias("score"), m["source"].alias("source")))
    return rows.select("doc_id", line.alias("line"), F.lit("keep").alias("op"), F.col("entity_id").alias("id"), *_FIELDS, flat.alias("mentions"), "cluster_id", "reason", F.array().cast("array<string>").alias("candidates"))


def to_jsonl(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """(doc_id, line, value): the JSON lines of each document's file, the header first; nulls are left out."""
    top = headers.join(lines.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.lit(1).alias("line"), F.to_json(F.struct(F.col("format").alias("$schema"), "doc_id", "text_sha", "schema_version")).alias("value"))
    body = lines.select("doc_id", "line", F.to_json(F.struct(*[c for c in lines.columns if c not in ("doc_id", "line")])).alias("value"))
    return top.union(body)


def _as_entity(lines: DataFrame) -> DataFrame:
    """Lines as entities: mentions take the line's type and, where they have no id, one of their place."""
    kind = F.col("type")

    def mention(m: Column) -> Column:
        source = F.coalesce(m["source"], F.lit("human"))
        own = ids.mention_id(F.col("doc_id"), m["start"], m["end"], source)
        return F.struct(F.coalesce(m["id"], own).alias("id"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), kind.alias("type"), F.coalesce(m["score"], F.lit(1.0)).alias("score"), source.alias("source"), F.lit(None).cast("string").alias("metadata"))

    placed = F.array_sort(F.transform("mentions", lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"), mention(m).alias("m"))))
    return lines.select("doc_id", "op", "line", F.col("id").alias("entity_id"), *_FIELDS, "cluster_id", F.transform(placed, lambda x: x["m"]).cast(f"array<{_MENTION_SQL}>").alias("mentions"))


def apply_review(rows: DataFrame, lines: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Entities after replaying review lines.

    `reject` drops (an unknown id is no matter); `keep` and `edit` both take the
    line as it is; `add` makes an entity, whose id must begin with ``human_``; what
    no line names stays.  Of several lines on one id the last counts.  Reading the
    result is an error for a `keep` or `edit` of an unknown id, a bad `add`, an
    unknown op or, given the documents, a span that differs from its text.
    """
    last = lines.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "id").orderBy(F.desc("line")))).filter("k = 1")
    edits = _as_entity(last)
    mine = edits.select("doc_id", "entity_id", "op", *[F.col(c).alias(f"new_{c}") for c in (*_FIELDS, "cluster_id", "mentions")])
    old = rows.withColumn("__old", F.lit(True))
    both = old.join(mine, ["doc_id", "entity_id"], "full")
    place = F.concat_ws("/", "doc_id", "entity_id")
    told = (
        F.when(F.col("op").isNotNull() & ~F.col("op").isin(*REVIEW_OPS), F.concat(F.lit("unknown op for "), place))
        .when(F.col("op").isin("keep", "edit") & F.col("__old").isNull(), F.concat(F.lit("line names an unknown entity "), place))
        .when((F.col("op") == "add") & ~F.col("entity_id").startswith("human_"), F.concat(F.lit("an added id must begin with human_: "), place))
    )
    both = both.filter(F.when(told.isNotNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    kept = both.filter(F.col("op").isNull() | (F.col("op") != "reject"))
    taken = F.col("op").isNotNull()
    out = kept.select("doc_id", "entity_id", *[F.when(taken, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in (*_FIELDS, "cluster_id", "mentions")])
    if docs is not None:
        body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__body"))
        wrong = F.exists("mentions", lambda m: F.substring(F.col("__body"), m["start"] + 1, m["end"] - m["start"]) != m["text"])
        out = out.join(body, "doc_id", "left")
        out = out.filter(F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.concat(F.lit("span differs from its document in "), place)).cast("boolean")).otherwise(True)).drop("__body")
    return out


def lint(lines: DataFrame, headers: DataFrame | None = None, docs: DataFrame | None = None, schema: EntitySchema | None = None, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, line, message) of everything wrong with review lines; the inputs that are given decide what is checked.

    Line 1 is the header, line 0 the file.
    """
    at = ["doc_id", "line"]
    lines = Store(lines.sparkSession, "lint").keep(lines, "lines")  # many checks read them
    found = [lines.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "id"))).filter("n > 1").select(*at, F.concat(F.lit("id repeats: "), "id").alias("message"))]
    found.append(lines.filter(~F.col("op").isin(*REVIEW_OPS)).select(*at, F.concat(F.lit("unknown op: "), "op").alias("message")))
    found.append(lines.filter((F.col("op") == "add") & ~F.col("id").startswith("human_")).select(*at, F.concat(F.lit("an added id must begin with human_: "), "id").alias("message")))
    found.append(lines.filter(F.coalesce(F.size("mentions"), F.lit(0)) < 1).select(*at, F.lit("no mentions").alias("message")))
    if schema is not None:
        found.append(lines.filter(~F.col("type").isin(schema.type_names)).select(*at, F.concat(F.lit("unknown type: "), "type").alias("message")))
    if rows is not None:
        known = rows.select("doc_id", F.col("entity_id").alias("id"))
        found.append(lines.filter(F.col("op").isin("keep", "edit", "reject")).join(known, ["doc_id", "id"], "left_anti").select(*at, F.concat(F.lit("unknown id: "), "id").alias("message")))
    sorted_ = F.array_sort(F.transform("mentions", lambda m: F.struct(m["start"].alias("s"), m["end"].alias("e"))))
    clash = lines.withColumn("__s", sorted_).withColumn("__bad", F.exists(F.sequence(F.lit(1), F.size("__s") - 1), lambda i: F.get("__s", i)["s"] < F.get("__s", i - 1)["e"]))
    found.append(clash.filter("size(mentions) > 1 and __bad").select(*at, F.lit("mentions overlap").alias("message")))
    if docs is not None:
        body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__body"))
        spans = lines.select(*at, F.explode("mentions").alias("m")).join(body, "doc_id", "left")
        place = F.concat_ws("-", F.col("m.start").cast("string"), F.col("m.end").cast("string"))
        out = F.col("__body").isNotNull() & ((F.col("m.start") < 0) | (F.col("m.end") <= F.col("m.start")) | (F.col("m.end") > F.length("__body")))
        found.append(spans.filter(out).select(*at, F.concat(F.lit("span out of bounds: "), place).alias("message")))
        differs = F.substring(F.col("__body"), F.col("m.start") + 1, F.col("m.end") - F.col("m.start")) != F.col("m.text")
        found.append(spans.filter(~out & differs).select(*at, F.concat(F.lit("text differs at "), place).alias("message")))
        found.append(lines.select("doc_id").distinct().join(body, "doc_id", "left_anti").select("doc_id", F.lit(0).alias("line"), F.lit("no such document").alias("message")))
    if headers is not None and docs is not None:
        sha = docs.select(F.col("doc_id").cast("string").alias("doc_id"), ids.text_sha(F.col("text")).alias("__sha"))
        found.append(headers.join(sha, "doc_id").filter("text_sha <> __sha").select("doc_id", F.lit(1).alias("line"), F.lit("the document's text has changed").alias("message")))
    if headers is not None:
        found.append(headers.filter(~F.col("format").rlike("^[^/]+/review/v1$")).select("doc_id", F.lit(1).alias("line"), F.concat(F.lit("unknown format: "), "format").alias("message")))
        if schema is not None:
            found.append(headers.filter(F.col("schema_version") != schema.version).select("doc_id", F.lit(1).alias("line"), F.concat(F.lit("schema version is "), "schema_version").alias("message")))
    out_ = found[0]
    for f in found[1:]:
        out_ = out_.union(f)
    return out_
