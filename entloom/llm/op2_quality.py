"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import bytesx as bx
from . import gbt
from .store import Store, small_batches

#: At most so many labelled documents train the trees, chosen by the hash of their ids.
TRAIN_ROWS = 12_000
KEEP_FROM = 0.5

_KINDS = ["lower", "upper", "digit", "blank", "line", "stop", "mark", "symbol", "lead", "rest", "control"]
_KIND = np.full(256, _KINDS.index("control"))
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9]] = 3
_KIND[[10, 13]] = 4
_KIND[[ord(c) for c in ".!?"]] = 5
_KIND[[ord(c) for c in ",;:'\"()-"]] = 6
_KIND[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 7
_KIND[192:256] = 8
_KIND[128:192] = 9
_ONE_HOT = np.eye(len(_KINDS))[_KIND]

FEATURES = [
    "log_bytes", "log_words", *(f"share_{k}" for k in _KINDS), "entropy", "word_mean", "word_std", "word_most", "short_words", "upper_words", "mixed_words",
    "distinct_words", "top_word", "distinct_trigrams", "lines_per_word", "line_mean", "repeated_lines", "stops_per_word", "marks_per_word",
]


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of every text, from all its bytes; zeros where there are none."""
    n = len(off) - 1
    size = np.diff(off)
    out = np.zeros((n, len(FEATURES)), dtype=np.float32)
    if not len(data):
        return out
    doc = np.repeat(np.arange(n), size)
    counts = np.bincount(doc * 256 + data, minlength=n * 256).reshape(n, 256)
    bytes_ = np.maximum(size, 1)
    share = counts / bytes_[:, None]
    kinds = counts @ _ONE_HOT
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)

    def per(rows: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        return np.bincount(rows, values, minlength=n)

    start, end, wdoc = bx.words(data, off)
    words = per(wdoc)
    some = np.maximum(words, 1)
    length = (end - start).astype(np.float64)
    mean = per(wdoc, length) / some
    spread = np.sqrt(np.maximum(per(wdoc, length**2) / some - mean**2, 0))
    most = np.zeros(n)
    top, distinct, trigrams = np.zeros(n), np.zeros(n), np.zeros(n)
    upper, mixed = np.zeros(n), np.zeros(n)
    if len(start):
        np.maximum.at(most, wdoc, length)
        ups = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
        in_word = ups[end] - ups[start]
        upper, mixed = per(wdoc, (in_word == length) & (length > 1)), per(wdoc, (in_word > 1) & (in_word < length))
        key = (wdoc.astype(np.uint64) << np.uint64(bx.ID_BITS)) | (bx.word_hashes(data, start, end) >> np.uint64(64 - bx.ID_BITS))
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        times, of = np.diff(np.append(new, len(key))), (key[new] >> np.uint64(bx.ID_BITS)).astype(np.int64)
        distinct = per(of)
        np.maximum.at(top, of, times)
        sdoc, _, stimes = bx.shingles(data, off, 3)
        trigrams = per(sdoc) / np.maximum(per(sdoc, stimes), 1)
    edge = np.unique(np.concatenate([off[:-1][size > 0], np.flatnonzero(data == 10) + 1]))
    edge = edge[edge < len(data)]
    stop = np.append(edge[1:], len(data))
    ldoc = np.searchsorted(off, edge, side="right") - 1
    lines = per(ldoc)
    with np.errstate(over="ignore"):
        up, down = bx.powers(len(data) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(bx._BYTE[data] * up[: len(data)])])
        line_hash = bx.mix((total[stop] - total[edge]) * down[edge])
    pair = np.stack([ldoc.astype(np.uint64), line_hash], axis=1)
    whole = per(np.unique(pair, axis=0)[:, 0].astype(np.int64))
    out[:] = np.stack(
        [
            np.log1p(size), np.log1p(words), *(kinds[:, k] / bytes_ for k in range(len(_KINDS))), entropy, mean, spread, most, per(wdoc, length <= 3) / some, upper / some, mixed / some,
            distinct / some, top / some, trigrams, lines / some, size / np.maximum(lines, 1), np.where(lines > 0, 1 - whole / np.maximum(lines, 1), 0), kinds[:, 5] / some, kinds[:, 6] / some,
        ],
        axis=1,
    )
    return out


def _measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        data, off = bx.buffers(batch.column(1))
        for lo, hi in bx.slices(off):
            x = statistics(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel(), pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], ["doc_id", "x"])


def measured(docs: DataFrame, store: Store) -> DataFrame:
    """(doc_id, x) with the statistics of every row, written once for training and scoring."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return store.keep(rows.mapInArrow(_measure, "doc_id long, x array<float>"), "statistics")


def training_rows(stats: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `most` labelled documents, by the hash of doc_id.

    Labels that are null are left out; a doc_id labelled both ways counts as good
    where most of its labels say so (a tie: not).
    """
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q")).dropna().groupBy("doc_id").agg((F.avg("q") > 0.5).cast("int").alias("y"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = stats.join(F.broadcast(one), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").toArrow()
    x = np.array(rows["x"].to_pylist(), dtype=np.float32).reshape(-1, len(FEATURES))
    return x, rows["y"].to_numpy().astype(np.float64)


def score(stats: DataFrame, trees_b) -> DataFrame:
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in it:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            yield pa.array(np.round(trees_b.value.score(x), 4)) if len(x) else pa.array([], pa.float64())

    quality = F.arrow_udf(run, "double")(F.col("x"))
    return stats.select("doc_id", quality.alias("quality")).select("doc_id", "quality", (F.col("quality") >= KEEP_FROM).alias("keep"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, quality, keep) of every row of `docs`, null doc_ids and repeated rows too.

    Null and empty texts have statistics of zeros and are scored like any other;
    statistics are of all bytes of a text, however long, and equal texts have equal
    scores.  Without labels of both kinds every score is the share of good labels
    (0.5 without any).  No rows give no rows.  Columns but doc_id, text and quality
    are not read, so their names don't matter.
    """
    spark = docs.sparkSession
    small_batches(spark)
    stats = measured(docs, Store(spark, "quality"))
    trees = gbt.fit(*training_rows(stats, labels))
    return score(stats, spark.sparkContext.broadcast(trees))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/labels.parquet"))
