"""URL filter: gradient-boosted trees on lexical features (operator 4).

The trees are trained on a fixed list of labelled URLs (`url_seeds.py`), never on
the table that is scored: a site of unknown standing there is no example of a good
one.  They see only lexical features and so extend the list to hosts that look
alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytesx as bx
from . import gbt
from .store import small_batches
from .url_seeds import BLOCKED, labelled_urls

#: At most so many labelled URLs train the trees, chosen by their hash.
TRAIN_ROWS = 20_000
BLOCK_FROM = 0.5
_SIGNS = "/?&=-._%"
#: The end of a host under which names are registered; under countries often in a second label. A host of digits, or of one label, has none.
SUFFIX = r"\.((?:(?:ac|co|com|edu|gob|gov|net|nom|or|org)\.)?[a-z]{2}|[^.]*[^.0-9][^.]*)\.?$"

FEATURES = ["length", "depth", "digit_ratio", "entropy", "parameters", "fragment", "host_length", "host_labels", "host_digits", "host_entropy", "host_vowels", "path_length", *(f"n_{ord(c)}" for c in _SIGNS), *(f"host_n_{ord(c)}" for c in "-."), "suffix_share", "suffix_rate"]


def parts(url: Column) -> dict[str, Column]:
    """Lower-cased URL, host, path, and suffix: the host's last label, or last two where names are registered under those (co.uk)."""
    u = F.lower(F.trim(url.cast("string")))
    rest = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, r"^([^/?#]*)", 1), r"^[^@]*@|:[0-9]*$", "")
    return {"url": u, "host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), "suffix": F.regexp_extract(host, SUFFIX, 1)}


def lexical(url: pa.Array, host: pa.Array, path: pa.Array, suffix: pa.Array, known: dict[str, tuple[float, float]]) -> np.ndarray:
    def table(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, off = bx.buffers(column)
        n = len(column)
        counts = np.bincount(np.repeat(np.arange(n), np.diff(off)) * 256 + data, minlength=n * 256).reshape(n, 256)
        size = np.diff(off)
        share = counts / np.maximum(size, 1)[:, None]
        return counts, size, -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    c, size, entropy = table(url)
    hc, hsize, hentropy = table(host)
    pc, psize, _ = table(path)
    ends = [known.get(s or "", (0.0, known.get("", (0.0, 0.5))[1])) for s in suffix.to_pylist()]
    share, rate = np.array([e[0] for e in ends]), np.array([e[1] for e in ends])
    digits = c[:, 48:58].sum(axis=1)
    vowels = hc[:, [ord(v) for v in "aeiou"]].sum(axis=1)
    columns = [
        size, pc[:, ord("/")], digits / np.maximum(size, 1), entropy, c[:, ord("=")], c[:, ord("#")] > 0, hsize, hc[:, ord(".")] + (hsize > 0), hc[:, 48:58].sum(axis=1), hentropy, vowels / np.maximum(hsize, 1), psize,
        *(c[:, ord(s)] for s in _SIGNS), *(hc[:, ord(s)] for s in "-."), share, rate,
    ]
    return np.stack(columns, axis=1).astype(np.float32)


def suffix_statistics(suffixes: list[str], y: np.ndarray) -> dict[str, tuple[float, float]]:
    """Share and smoothed rate of label 1 of each suffix among the labelled; '' has the rate of all."""
    overall = float(y.mean()) if len(y) else 0.5
    found = {"": (0.0, overall)}
    for s in sorted(set(suffixes) - {""}):
        at = np.array([x == s for x in suffixes])
        found[s] = (float(at.mean()), float((y[at].sum() + 20 * overall) / (at.sum() + 20)))
    return found


def train(labelled: DataFrame, most: int = TRAIN_ROWS) -> tuple[gbt.Trees, dict[str, tuple[float, float]]]:
    """Trees and suffix statistics from (url, label); a URL labelled both ways counts as 1. Nulls don't train."""
    one = labelled.select(F.col("url").cast("string").alias("url"), F.col("label").cast("int").alias("y")).dropna().groupBy("url").agg(F.max("y").alias("y"))
    rows = one.orderBy(F.xxhash64("url"), "url").limit(most).select("y", *(c.alias(k) for k, c in parts(F.col("url")).items())).toArrow()
    y = rows["y"].to_numpy().astype(np.float64)
    known = suffix_statistics(rows["suffix"].to_pylist(), y)
    x = lexical(*(rows[k].combine_chunks() if len(rows) else pa.array([], pa.string()) for k in ("url", "host", "path", "suffix")), known)
    return gbt.fit(x, y), known


def listed(url: Column) -> Column:
    """Whether the host is a listed site or part of one, under any suffix of one or two labels."""
    names = "|".join(re.escape(name) for name in BLOCKED)
    return parts(url)["host"].rlike(rf"(^|\.)({names})(\.[^.]+){{1,2}}\.?$")


def score(pages: DataFrame, model_b) -> DataFrame:
    """(page_id, url, score, blocked) of every row.

    A null or empty URL is blocked with score 1: nothing can be fetched from it.
    So is a URL of a listed site, whatever the trees say.  Rows that repeat, and
    null page_ids, are carried as they are; URLs of any length are read whole.  No
    rows give no rows.  Columns but page_id and url are not read, so their names
    don't matter.
    """

    def run(it: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        trees, known = model_b.value
        for url, host, path, suffix in it:
            yield pa.array(np.round(trees.score(lexical(url, host, path, suffix, known)), 4)) if len(url) else pa.array([], pa.float64())

    p = parts(F.col("url"))
    found = F.arrow_udf(run, "double")(*(F.coalesce(p[k], F.lit("")) for k in ("url", "host", "path", "suffix")))
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), found.alias("found"))
    value = F.when((F.coalesce(F.trim("url"), F.lit("")) == "") | listed(F.col("url")), 1.0).otherwise(F.col("found"))
    return rows.select("page_id", "url", value.alias("score")).select("page_id", "url", "score", (F.col("score") >= BLOCK_FROM).alias("blocked"))


def seed_labels(pages: DataFrame) -> DataFrame:
    """(url, label) of the URLs of a table: 1 for a listed site.

    0 is any other host, of unknown standing: those rows are no negatives to train on.
    """
    return pages.select("url", F.coalesce(listed(F.col("url")), F.lit(False)).cast("int").alias("label"))


def filter_urls(pages: DataFrame, labelled: DataFrame) -> DataFrame:
    """Scores of all pages by trees trained on `labelled`, a table (url, label) of any labelled URLs; see :func:`train` and :func:`score`."""
    spark = pages.sparkSession
    small_batches(spark)
    return score(pages, spark.sparkContext.broadcast(train(labelled)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return filter_urls(pages, spark.createDataFrame(labelled_urls(), "url string, label int"))
