"""Documents to mentions: extraction, snapping to tokens, non-overlap selection, checks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..backends import Extractor
from ..functions import ids, text, tokens
from ..schema import EntitySchema, EntityType


@dataclass(frozen=True)
class Rule:
    """A regular expression whose matches are mentions of a type."""

    label: str
    pattern: str
    score: float = 1.0
    needs: str = ""  # what every text with a match contains; a plain search for it saves the expression


RULES = (
    Rule("Email", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+\.[A-Za-z]+", 0.99, "@"),
    Rule("IPv4", r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", 0.95),
    Rule("License", r"(?:Apache License|General Public License|MIT License)", 0.9, "License"),
    Rule("Phone", r"\+?[0-9][0-9 ()-]{7,}[0-9]", 0.75),
    Rule("ProperName", r"[A-Z][a-z]+ [A-Z][a-z]+", 0.6),
    Rule("ProperName", r"[A-Z][a-z]+ [A-Z][a-z]+ [A-Z][a-z]+", 0.45),
)

#: Guesses at the types of the default schema, for runs without a model: by form and by the words beside.
NAME_RULES = (
    Rule("Organization", r"\b(?:[A-Z][\w&.-]* )+(?:Inc|Ltd|LLC|Corp|Corporation|Company|GmbH|AG|University|Institute|Association|Agency|Bank|Party|Society|Council|Ministry|Group)\b", 0.8),
    Rule("Organization", r"\b(?:University|Institute|Ministry|Bank|Bureau|Department) of (?:[A-Z]\w+ ?)+\b", 0.8),
    Rule("Location", r"(?<=\b(?:in|at|from|near|to|of) )(?:(?:the )?(?:North|South|East|West|New|San|Saint) )?[A-Z][a-z]+\b(?! [A-Z])", 0.6),
    Rule("Person", r"\b(?<!\b(?:University|Institute|Ministry|Bank) of )[A-Z][a-z]+ (?:[A-Z]\. )?(?:van |von |de )?[A-Z][a-z]+\b(?! (?:Inc|Ltd|LLC|Corp|GmbH|University|Institute|Association|Agency|Bank|Society|Council|Ministry|Group))", 0.6),
)


def extract_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, start, end, text, label, score, source) of all rules' matches, in one pass over the documents."""
    doc_id, body = F.col("doc_id").cast("string"), F.col("text")

    def of(rule: Rule) -> Column:
        found = F.transform(text.spans(body, rule.pattern), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), F.lit(rule.label).alias("label"), F.lit(rule.score).alias("score")))
        some = F.rlike(body, F.lit(rule.pattern))
        return F.when(body.contains(rule.needs) & some if rule.needs else some, found).otherwise(F.array().cast("array<struct<start:int,end:int,text:string,label:string,score:double>>"))

    found = [of(rule) for rule in rules]
    rows = docs.select(doc_id.alias("doc_id"), F.explode(F.concat(*found)).alias("m"))
    return rows.select("doc_id", "m.*", F.lit("regex").alias("source"))


#: First tokens of names are sent to all executors up to this many names; beyond it every stretch of tokens goes to the join.
SENT_NAMES = 1_000_000


def extract_gazetteer(docs: DataFrame, names: DataFrame, score: float = 1.0) -> DataFrame:
    """Mentions of the names of a table (label, name) that begin and end with a token.

    A name's tokens are the same wherever it stands as whole tokens.  So each text's
    stretches of as many tokens as names have, made where the text is, are joined to
    the names themselves; no text is moved.
    """
    listed = names.select("label", "name", F.regexp_extract("name", "(?U)^(?:" + text.TOKEN + ")", 0).alias("token"), text.token_count(F.col("name")).alias("n")).filter("token <> ''")
    sizes = sorted(r.n for r in listed.select("n").distinct().collect())
    few = listed.select("token").distinct().limit(SENT_NAMES + 1).toArrow()["token"].combine_chunks() if sizes else pa.array([], pa.string())
    openers = docs.sparkSession.sparkContext.broadcast(few if len(few) <= SENT_NAMES else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in tokens.pieces(batch.column(1)):
                row, start, end, gram = tokens.grams(batch.column(1)[k], sizes, openers.value)
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].take(pa.array(row)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), gram], ["doc_id", "start", "end", "text"])

    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "doc_id string, start int, end int, text string")
    found = found.join(listed.select("label", F.col("name").alias("text")), "text")
    return found.select("doc_id", "start", "end", "text", "label", F.lit(score).alias("score"), F.lit("regex").alias("source"))


def extract_with(docs: DataFrame, schema: EntitySchema, backend: Extractor, source: str = "gliner") -> DataFrame:
    """Raw predictions of a model backend, loaded once in each Python worker."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, p.start, p.end, p.label, p.score) for d, t in zip(batch["doc_id"], batch["text"], strict=True) for p in backend.predict(t, schema)]
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "label", "score"])

    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").filter("text is not null and text <> ''")
    return body.mapInPandas(run, "doc_id string, start int, end int, label string, score double").withColumn("source", F.lit(source))


def _label(template: str, kind: EntityType) -> str:
    return template.format(**vars(kind))


def label_types(raw: DataFrame, schema: EntitySchema, template: str = "{name}") -> DataFrame:
    """`type` for each label; predictions of labels that no type makes are dropped (see :func:`unknown_labels`)."""
    rows = [(_label(template, t), t.name) for t in schema.types]
    types = raw.sparkSession.createDataFrame(rows, "label string, type string")
    return raw.join(F.broadcast(types), "label").drop("label")


def unknown_labels(raw: DataFrame, schema: EntitySchema, template: str = "{name}") -> DataFrame:
    """Labels, with their number of predictions, that no type of the schema makes."""
    known = [_label(template, t) for t in schema.types]
    return raw.filter(~F.col("label").isin(known)).groupBy("label").agg(F.count("*").alias("n"))


def token_offsets(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, token) of every token, found where the text is: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in tokens.pieces(batch.column(1)):
                row, start, end, token = tokens.offsets(batch.column(1)[k])
                yield pa.RecordBatch.from_arrays([batch.column(0)[k].take(pa.array(row)), pa.array(start, pa.int32()), pa.array(end, pa.int32()), token], ["doc_id", "start", "end", "token"])

    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id string, start int, end int, token string")


def snap(spans: DataFrame, docs: DataFrame) -> DataFrame:
    """Spans widened to the tokens that their ends cut, then trimmed of white space.

    The spans of a document are one row, so its text is joined and taken into tokens
    once, however many they are.  Spans out of the text's bounds, or empty, stay as
    they are.  `spans` has (doc_id, start, end) and any more columns; `text` is set
    to what is covered.
    """
    others = [c for c in spans.columns if c not in ("doc_id", "start", "end", "text")]
    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("body"))
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end", *others)).alias("ms")).join(body, "doc_id")

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            yield tokens.snapped(*batch)

    placed = F.arrow_udf(run, "array<struct<start:int,end:int,text:string>>").asNondeterministic()("body", "ms.start", "ms.end")
    rows = grouped.select("doc_id", "ms", placed.alias("placed")).select("doc_id", F.explode(F.arrays_zip("placed", "ms")).alias("x"))
    return rows.select("doc_id", "x.placed.start", "x.placed.end", *[F.col("x.ms").getField(c).alias(c) for c in others], "x.placed.text")


def overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def select_spans(mentions: DataFrame) -> DataFrame:
    """In each (doc_id, type), greedily the best spans that don't overlap; types may overlap each other.

    Best is the higher score, then the earlier start, then the longer; an exact tie
    keeps the row that is least by its other columns.
    """
    rest = [c for c in mentions.columns if c not in ("doc_id", "type")]
    others = [c for c in rest if c not in ("start", "end", "score", "metadata")]
    # spans of different stretches of overlapping ones have nothing to do with each other
    w = Window.partitionBy("doc_id", "type").orderBy("start", "end")
    ahead = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    apart = mentions.withColumn("__apart", (F.col("start") >= ahead).cast("int")).withColumn("__stretch", F.coalesce(F.sum("__apart").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    key = F.struct((-F.col("score")).alias("k1"), F.col("start").alias("k2"), (F.col("start") - F.col("end")).alias("k3"), *[F.col(c).alias(f"k_{c}") for c in others], F.struct(*rest).alias("row"))
    groups = apart.groupBy("doc_id", "type", "__stretch").agg(F.array_sort(F.collect_list(key)).alias("ranked"))
    row = mentions.select(F.array(F.struct(*rest)).alias("x")).schema["x"].dataType.simpleString()
    kept = F.aggregate("ranked", F.array().cast(row), lambda acc, r: F.when(F.exists(acc, lambda x: overlaps(x, r["row"])), acc).otherwise(F.array_append(acc, r["row"])))
    return groups.select("doc_id", "type", F.explode(kept).alias("m")).select("doc_id", "type", "m.*").select(*mentions.columns)


def mentions(raw: DataFrame) -> DataFrame:
    """Typed spans to mention rows: empty ones dropped, ids given, the non-overlapping chosen."""
    df = raw.filter("end > start and text <> ''").withColumn("id", ids.mention_id(F.col("doc_id"), F.col("start"), F.col("end"), F.col("source")))
    return select_spans(df.select("doc_id", "id", "start", "end", "text", "type", "score", "source"))


def span_violations(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """Mentions whose text isn't what the document has there; must be empty."""
    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__body"))
    bad = "__body IS NULL OR start < 0 OR end <= start OR end > length(__body) OR substring(__body, start + 1, end - start) <> text OR length(text) <> end - start"
    return rows.join(body, "doc_id", "left").filter(bad).drop("__body")


def checked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The same rows; reading one that violates its span is an error."""
    body = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").alias("__body"))
    ok = F.expr("__body IS NOT NULL AND start >= 0 AND end > start AND substring(__body, start + 1, end - start) = text")
    told = F.concat(F.lit("span differs from its document: "), F.col("doc_id"), F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"))
    return rows.join(body, "doc_id", "left").filter(F.when(ok, True).otherwise(F.raise_error(told).cast("boolean"))).drop("__body")


def type_overlaps(rows: DataFrame) -> DataFrame:
    """Pairs of mentions of different types that overlap; they are kept on purpose."""
    a = rows.select("doc_id", F.col("start").alias("start_a"), F.col("end").alias("end_a"), F.col("type").alias("type_a"))
    b = rows.select("doc_id", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("type").alias("type_b"))
    return a.join(b, "doc_id").filter("type_a < type_b and start_a < end_b and start_b < end_a")
