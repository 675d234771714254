"""Text files to a documents table."""

from __future__ import annotations

from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, text, source) of a folder's .txt and .md files (at any depth), one file, or a glob.

    The doc_id is the file's name without suffix; two files of one name are an
    error, as are no files.  Line ends become \\n before any offset is taken.
    """
    options = {"wholetext": True}
    if files.is_folder(spark, where):
        raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md}").text(where, **options)
    elif "**" in where and "://" not in where:  # which Hadoop's globs don't know
        root, _, pattern = where.partition("**")
        found = sorted(str(p) for p in Path(root or ".").glob("**" + pattern) if p.is_file())
        if not found:
            raise FileNotFoundError(f"no files match {where}")
        raw = spark.read.text(found, **options)
    else:
        if not any(c in where for c in "*?[{") and not files.exists(spark, where):
            raise FileNotFoundError(f"no file or folder {where}")
        try:
            raw = spark.read.text(where, **options)
        except AnalysisException as e:
            raise FileNotFoundError(f"no files match {where}") from e
    if not raw.inputFiles():
        raise FileNotFoundError(f"no .txt or .md files in {where}")
    name = F.regexp_extract(F.url_decode(F.regexp_replace("source", r"\+", "%2B")), r"([^/]+?)(?:\.[^./]*)?$", 1)
    docs = raw.select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))
    docs = docs.select(name.alias("doc_id"), F.regexp_replace("text", "\r\n?", "\n").alias("text"), "source")
    again = [r.doc_id for r in docs.groupBy("doc_id").count().filter("count > 1").select("doc_id").collect()]
    if again:
        raise ValueError(f"documents share a name: {sorted(again)[:5]}")
    return docs


def read_table(spark: SparkSession, where: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, source) of a Parquet table."""
    df = spark.read.parquet(where)
    return df.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).cast("string").alias("text"), (F.col("source").cast("string") if "source" in df.columns else F.lit(None).cast("string")).alias("source"))


#: A table of more bytes than this is never moved only to have more splits.
SPREAD_BYTES = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """The same rows, dealt out evenly where a small table (SPREAD_BYTES by the planner's estimate) has fewer splits than there are cores.

    A table of one row group is one task otherwise, whatever is computed from it.
    """
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SPREAD_BYTES:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
