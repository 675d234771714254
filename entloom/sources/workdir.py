"""The tables of a run in one folder, Parquet first, with JSON beside it for people and other tools."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids
from ..model import CENTROID, ENTITY, GOLD, REGISTRY, REVIEW_LINE
from ..operators.evaluate import gold_duplicates
from ..schema import EntitySchema, parse_schema, schema_text
from ..store import Store
from . import files

_ENTITIES = "array<struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ENTITY.fields if f.name != "doc_id") + ">>"
_HEADER = "`$schema` string, doc_id string, text_sha string, schema_version string"


class Workdir:
    """documents/, entities/, registry/, centroids/ (Parquet), review/ (JSON lines), schema.yaml, manifest.json."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, str(root).rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def has(self, name: str) -> bool:
        return files.exists(self.spark, self.path(name))

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes a table; one that is read from the same place is written elsewhere first."""
        if self.has(name):
            df = Store(self.spark, "workdir").keep(df, name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def load(self, name: str) -> DataFrame:
        if not self.has(name):
            raise FileNotFoundError(f"no {name} in {self.root}")
        schema = {"entities": ENTITY, "registry": REGISTRY, "centroids": CENTROID}.get(name)
        reader = self.spark.read.schema(schema) if schema is not None else self.spark.read
        return reader.parquet(self.path(name))

    def views(self, prefix: str = "") -> list[str]:
        """Registers the folder's tables, and the mentions of its entities, as views for spark.sql; their names."""
        found = []
        for name in ("documents", "entities", "registry", "centroids", "flagged", "vectors"):
            if self.has(name):
                self.load(name).createOrReplaceTempView(prefix + name)
                found.append(prefix + name)
        if prefix + "entities" in found:
            self.load("entities").select("doc_id", "entity_id", "cluster_id", F.explode("mentions").alias("m")).select("doc_id", "entity_id", "cluster_id", "m.*").createOrReplaceTempView(prefix + "mentions")
            found.append(prefix + "mentions")
        return found

    def save_schema(self, schema: EntitySchema) -> None:
        files.write_text(self.spark, self.path("schema.yaml"), schema_text(schema, ".yaml"))

    def schema(self) -> EntitySchema:
        return parse_schema(files.read_text(self.spark, self.path("schema.yaml")), ".yaml")

    def write_manifest(self, schema: EntitySchema, counts: dict[str, int]) -> dict:
        body = dict(created_at=str(datetime.now(UTC).isoformat()), schema_fingerprint=schema.fingerprint(), schema_version=schema.version, **counts)
        files.write_text(self.spark, self.path("manifest.json"), json.dumps(body, indent=2))
        return body

    def manifest(self) -> dict:
        return json.loads(files.read_text(self.spark, self.path("manifest.json")))


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a row; nulls are left out."""
    df.write.mode("overwrite").json(path)


def read_entities_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTITY).json(path)


def _write_files(rows: DataFrame, folder: str, suffix: str) -> None:
    """A file for each row of (file, vs), of the lines `vs`, written by the executors; `folder` is a path or URI that all of them see."""

    def write(part) -> None:
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(base, recursive=True)
        for row in part:
            with system.open_output_stream(f"{base}/{row.file}{suffix}") as out:
                out.write("".join(v + "\n" for v in row.vs).encode("utf-8"))

    files.make_folder(rows.sparkSession, folder)  # also where there is nothing to write
    rows.foreachPartition(write)


def write_review(lines: DataFrame, folder: str) -> None:
    """A file a document, `<safe name>.jsonl`; `lines` is (doc_id, line, value)."""
    named = lines.withColumn("file", ids.safe_filename(F.col("doc_id")))
    grouped = named.groupBy("doc_id", "file").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("xs"))
    _write_files(grouped.select("file", F.transform("xs", lambda x: x["value"]).alias("vs")), folder, ".jsonl")


def export_extractions(entities: DataFrame, docs: DataFrame, folder: str) -> None:
    """A JSON file a document, `<safe name>.json`: {document, entities}, entities in order of their first mention."""
    first = F.get("mentions", F.lit(0))["start"]
    mine = entities.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), "entity_id", F.struct(*[c for c in ENTITY.fieldNames() if c != "doc_id"]).alias("e")))).alias("es"))
    document = F.struct("doc_id", "text").alias("document")
    listed = F.coalesce(F.transform("es", lambda x: x["e"]), F.array().cast(_ENTITIES)).alias("entities")
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").join(mine, "doc_id", "left")
    _write_files(rows.select(ids.safe_filename(F.col("doc_id")).alias("file"), F.array(F.to_json(F.struct(document, listed))).alias("vs")), folder, ".json")


def import_extractions(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(documents, entities) of a folder of files as :func:`export_extractions` writes them."""
    raw = spark.read.option("pathGlobFilter", "*.json").schema(f"document struct<doc_id:string,text:string>, entities {_ENTITIES}").json(folder)
    rows = raw.select("document.doc_id", F.explode("entities").alias("e")).select("doc_id", "e.*")
    return raw.select("document.*"), rows.select(*ENTITY.fieldNames())


def read_review(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, lines) of one review file or a folder of them.

    Blank lines don't count.  A file's doc_id is its header's; of two files with one
    doc_id the later by name counts.  Reading a line that isn't an object with the
    known keys, or an empty file, is an error.
    """
    if not files.exists(spark, path):
        raise FileNotFoundError(f"no review files at {path}")
    reader = spark.read.option("pathGlobFilter", "*.jsonl") if files.is_folder(spark, path) else spark.read
    raw = reader.text(path, wholetext=True)
    if not raw.inputFiles():
        raise FileNotFoundError(f"no review files at {path}")
    raw = raw.select(F.col("_metadata.file_path").alias("file"), "value")
    if empty := raw.filter(~F.col("value").rlike(r"\S")).first():
        raise ValueError(f"review file is empty: {empty.file}")
    raw = raw.select("file", F.posexplode(F.split("value", "\r?\n", -1)).alias("k", "value"))
    raw = raw.filter(F.length(F.trim("value")) > 0)
    raw = raw.withColumn("line", F.row_number().over(Window.partitionBy("file").orderBy("k")))
    head = raw.filter("line = 1").select("file", F.from_json("value", _HEADER).alias("h")).select("file", F.col("h.`$schema`").alias("format"), "h.doc_id", "h.text_sha", "h.schema_version")
    told = F.concat(F.lit("no review header in "), F.col("file"))
    head = head.filter(F.when(F.col("doc_id").isNull() | F.col("format").isNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    head = head.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("file")))).filter("r = 1").drop("r")
    known = [f.name for f in REVIEW_LINE.fields]
    keys = F.json_object_keys("value")
    bad = keys.isNull() | (F.size(F.array_except(keys, F.array(*[F.lit(k) for k in known]))) > 0)
    body = raw.filter("line > 1").withColumn("x", F.from_json("value", REVIEW_LINE))
    told = F.concat(F.lit("bad review line in "), F.col("file"), F.lit(":"), F.col("line").cast("string"))
    body = body.filter(F.when(bad | F.col("x.id").isNull(), F.raise_error(told).cast("boolean")).otherwise(True))
    lines = body.join(head.select("file", "doc_id"), "file").select("doc_id", F.col("line").cast("int").alias("line"), F.coalesce("x.op", F.lit("keep")).alias("op"), *[f"x.{c}" for c in known if c not in ("op",)])
    return head.drop("file"), lines


def load_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold rows of a JSON lines file; blank lines and lines that begin with # don't count. A repeated entity is an error."""
    raw = spark.read.text(path).select(F.trim("value").alias("value")).filter("value <> '' and not startswith(value, '#')")
    gold = raw.select(F.from_json("value", GOLD).alias("g")).select("g.*")
    wrong = F.greatest(*[F.coalesce(F.length(c), F.lit(0)) == 0 for c in gold.columns])
    gold = gold.filter(F.when(wrong, F.raise_error(F.lit("a gold line lacks doc_id, entity_id or gold_cluster_id")).cast("boolean")).otherwise(True))
    again = [f"{r.doc_id}/{r.entity_id}" for r in gold_duplicates(gold).collect()]
    if again:
        raise ValueError(f"gold has these entities twice: {sorted(again)[:5]}")
    return gold


def save_gold(gold: DataFrame, path: str) -> None:
    """As a folder of JSON lines."""
    gold.select(F.to_json(F.struct("doc_id", "entity_id", "gold_cluster_id")).alias("value")).write.mode("overwrite").text(path)
