"""Near-duplicate groups by consistent weighted sampling (operator 6).

Documents are bags of word 3-grams weighted by (1 + ln tf) * idf.  Improved
consistent weighted sampling (Ioffe 2010) draws BANDS * ROWS samples; documents
that agree on a whole band are candidates, and a candidate pair counts when its
exact weighted Jaccard similarity reaches `threshold`.  Groups are the connected
components of these pairs and of exact copies.

Document frequencies are counted over all documents in 2**DF_BITS hashed
counters (a fixed-size table, so the broadcast doesn't grow with the corpus).  A
shingle in the share s of the documents has idf ln(1 + 1 / (s + IDF_SMOOTH)): it
falls with every further document, depends on shares alone and so means the same
at every size, and the smoothing keeps the words that were changed in a copy from
outweighing all that it shares with a family of thousands.

A node of the graph is a row's text under its doc_id, so one doc_id with two texts
is two nodes and neither text stands for the other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.components import components
from ..sources.documents import spread
from . import bytesx as bx
from .names import column, free
from .store import Store, small_batches

NGRAM = 3
BANDS, ROWS = 22, 3
THRESHOLD = 0.5
DF_BITS = 20
IDF_SMOOTH = 0.005
#: Ids of candidate documents are broadcast up to this many rows (about 24 MB); beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Each round compares so many times more members of a bucket with all others than the round before.
LEADS_GROW = 64
#: Members of one bucket that are joined in one task.
SALT_ROWS = 1 << 16
_CHUNKS = 16
_TABLE_BITS = 15

_rng = np.random.default_rng(61)
_n = 1 << _TABLE_BITS
_LOW = np.uint64(_n - 1)
_R = _rng.gamma(2.0, 1.0, _n).astype(np.float32)
_INV_R = (1.0 / _R).astype(np.float32)
_LN_C = np.log(_rng.gamma(2.0, 1.0, _n)).astype(np.float32)
_BETA = _rng.random(_n).astype(np.float32)
_A = _rng.integers(1, 1 << 63, (BANDS * ROWS, 2), dtype=np.uint64) | np.uint64(1)
_BAND_MIX = _rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)


def weights(ids: np.ndarray, times: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return ((1.0 + np.log(times)) * idf[(ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64)]).astype(np.float32)


def idf_table(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.log1p(1.0 / (np.maximum(df, 1) / max(n_docs, 1) + IDF_SMOOTH)).astype(np.float32)


def sample(ids: np.ndarray, w: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, one row for each document that begins in `starts`."""
    out = np.empty((len(starts), BANDS * ROWS), dtype=np.uint32)
    bounds = np.append(starts, len(ids))
    lo = 0
    with np.errstate(over="ignore"):
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + 32768, side="right")) - 1)
            part = slice(bounds[lo], bounds[hi])
            x, ln_w = ids[part], np.log(w[part])
            low = x.astype(np.uint32)
            at = (bounds[lo:hi] - bounds[lo]).astype(np.int64)
            for k in range(BANDS * ROWS):
                h = x * _A[k, 0] + _A[k, 1]
                slot, other = (h >> np.uint64(64 - _TABLE_BITS)).view(np.int64), ((h >> np.uint64(64 - 2 * _TABLE_BITS)) & _LOW).view(np.int64)
                beta = _BETA[slot]
                t = np.floor(ln_w * _INV_R[slot] + beta)
                # ln a = ln c - r (t - beta + 1); the least wins
                ln_a = _LN_C[other] - _R[slot] * (t - beta + np.float32(1))
                order = ln_a.view(np.int32)
                order = order ^ ((order >> 31) & np.int32(0x7FFFFFFF))
                name = low ^ (t.astype(np.int32).view(np.uint32) * np.uint32(0x9E3779B1))
                key = (order.astype(np.int64) << 32) | name.astype(np.int64)
                out[lo:hi, k] = np.minimum.reduceat(key, at).astype(np.uint32)
            lo = hi
    return out


def bands(samples: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band."""
    with np.errstate(over="ignore"):
        s = samples.astype(np.uint64).reshape(len(samples), BANDS, ROWS)
        h = np.broadcast_to(_BAND_MIX, (len(s), BANDS)).copy()
        for k in range(ROWS):
            h = bx.mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, k])
    return h.view(np.int64)


def _document_frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, n = np.zeros(1 << DF_BITS, dtype=np.int64), 0
    for batch in it:
        data, off = bx.buffers(batch.column(0))
        n += len(batch)
        for lo, hi in bx.slices(off):
            _, ids, _ = bx.shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], NGRAM)
            counts += np.bincount((ids & np.uint64((1 << DF_BITS) - 1)).astype(np.int64), minlength=1 << DF_BITS)
    if n:
        parts = np.split(counts, _CHUNKS)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, _CHUNKS), pa.int32()), pa.array([n] + [0] * _CHUNKS, pa.int64()), pa.array([b""] + [zlib.compress(p.astype("<u8").tobytes(), 1) for p in parts], pa.binary())], ["chunk", "n", "counts"])


def _add_frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    n = 0
    for batch in it:
        for chunk, k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            n += k
            if chunk >= 0:
                part = np.frombuffer(zlib.decompress(raw), dtype="<u8").astype(np.int64)
                total[chunk] = total[chunk] + part if chunk in total else part
    keys = list(total)
    yield pa.RecordBatch.from_arrays([pa.array([-1, *keys], pa.int32()), pa.array([n] + [0] * len(keys), pa.int64()), pa.array([b""] + [zlib.compress(total[k].astype("<u8").tobytes(), 1) for k in keys], pa.binary())], ["chunk", "n", "counts"])


_DF_SCHEMA = "chunk int, n long, counts binary"


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Hashed document frequencies of shingles, and the number of documents; over all rows."""
    parts = docs.select(F.col("text").cast("string")).mapInArrow(_document_frequencies, _DF_SCHEMA)
    rows = parts.repartition(_CHUNKS + 1, "chunk").mapInArrow(_add_frequencies, _DF_SCHEMA).collect()
    counts = np.zeros((_CHUNKS, (1 << DF_BITS) // _CHUNKS), dtype=np.int64)
    for r in rows:
        if r.chunk >= 0:
            counts[r.chunk] = np.frombuffer(zlib.decompress(bytes(r.counts)), dtype="<u8")
    return counts.ravel(), sum(r.n for r in rows)


def _sketcher(idf_b):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_b.value
        for batch in it:
            names = [batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]
            data, off = bx.buffers(batch.column(2))
            for lo, hi in bx.slices(off):
                doc, ids, times = bx.shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], NGRAM)
                if not len(doc):
                    continue
                w = weights(ids, times, idf)
                starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                keys = bands(sample(ids, w, starts))
                with np.errstate(over="ignore"):
                    one = bx.mix(ids * np.uint64(0x9E3779B97F4A7C15) + times.astype(np.uint64))
                    two = bx.mix(one ^ np.uint64(0xC2B2AE3D27D4EB4F))
                    fp1, fp2 = np.add.reduceat(one, starts).view(np.int64), np.add.reduceat(two, starts).view(np.int64)
                total = np.add.reduceat(w.astype(np.float64), starts)
                flat = pa.array(keys.ravel(), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([*(pa.array(x[lo:hi][doc[starts]], pa.int64()) for x in names), pa.array(fp1), pa.array(fp2), pa.array(total), lists], ["doc_id", "version", "fp1", "fp2", "wsum", "bands"])

    return run


def _verifier(idf_b):
    def one_side(column: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        data, off = bx.buffers(column)
        doc, ids, times = bx.shingles(data, off, NGRAM)
        w = weights(ids, times, idf).astype(np.float64)
        with np.errstate(over="ignore"):
            return (doc.astype(np.uint64) << np.uint64(bx.ID_BITS)) | ids, w, np.bincount(doc, w, minlength=len(column))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = idf_b.value
        for batch in it:
            size = bx.buffers(batch.column(2))[1] + bx.buffers(batch.column(3))[1]
            for lo, hi in bx.slices(size, 2 * bx.SLICE_BYTES):
                part = batch.slice(lo, hi - lo)
                ka, wa, ta = one_side(part.column(2), idf)
                kb, wb, tb = one_side(part.column(3), idf)
                at = np.searchsorted(ka, kb)
                at[at == len(ka)] = 0
                same = ka[at] == kb if len(ka) else np.zeros(len(kb), bool)
                both = np.bincount((kb[same] >> np.uint64(bx.ID_BITS)).astype(np.int64), np.minimum(wa[at[same]], wb[same]), minlength=len(part))
                sim = both / np.maximum(ta + tb - both, 1e-12)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sim)], ["a", "b", "similarity"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, idf_b, threshold: float) -> DataFrame:
    """Similarity of (a, b), where it reaches the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "ta", "tb")
    return rows.mapInArrow(_verifier(idf_b), "a long, b long, similarity double").filter(F.col("similarity") >= threshold).select("a", "b")


def _small(df: DataFrame) -> DataFrame:
    """To be broadcast, if a written table of ids has no more than BROADCAST_ROWS."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _version(text: Column) -> Column:
    """Tells the texts of one doc_id apart."""
    return F.xxhash64(text, text.isNull())


def _candidates(sketch: DataFrame, exact: DataFrame, store: Store) -> DataFrame:
    """(key, node, wsum, lead, lead_wsum, n): buckets with two nodes or more, of exact copies only one each."""
    once = sketch.join(exact.select(F.col("b").alias("node")), "node", "left_anti")
    keys = once.select("node", "wsum", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.min("node").alias("lead"), F.min_by("wsum", "node").alias("lead_wsum"), F.count("*").alias("n")).filter("n > 1")
    return store.keep(keys.join(many, "key"), "member")


def _edges(docs: DataFrame, sketch: DataFrame, exact: DataFrame, idf_b, threshold: float, store: Store) -> DataFrame:
    """(a, b) of verified pairs that, with `exact`, connect every two nodes of a bucket that are similar.

    First all members of a bucket are compared with its lead, the least node.  Two
    members that are in one component need no comparison any more; a bucket is done
    when it has one component.  In every further round a bucket's leads, chosen by
    hash, are LEADS_GROW times as many, and are compared with the members of other
    components, until all members of all open buckets have been leads.
    """
    heavy = F.least("wa", "wb") >= F.greatest("wa", "wb") * (threshold - 1e-9)
    member = _candidates(sketch, exact, store)
    seen = store.keep(member.select(F.col("lead").alias("a"), F.col("node").alias("b"), F.col("lead_wsum").alias("wa"), F.col("wsum").alias("wb")).filter("a <> b").filter(heavy).select("a", "b").distinct(), "pairs-0")
    ids = _small(store.keep(member.select("node").distinct(), "nodes"))
    wanted = _small(store.keep(sketch.select("node", "doc_id", "version").join(ids, "node", "left_semi"), "wanted"))
    texts = docs.join(wanted, ["doc_id", "version"]).groupBy("node").agg(F.first("text").alias("text"))
    texts = store.keep(texts, "texts")
    edges, pairs, k = store.keep(_verified(seen, texts, idf_b, threshold), "near-0"), seen, 0
    while True:
        k += 1
        root = components(edges).select("node", F.col("root").alias("part"))
        placed = member.select("key", "node", "wsum", "n").join(root, "node", "left").withColumn("part", F.coalesce("part", "node"))
        open_ = placed.groupBy("key").agg(F.min("part").alias("p"), F.max("part").alias("q")).filter("p <> q").select("key")
        open_ = store.keep(placed.join(open_, "key"), f"open-{k}")
        largest = open_.agg(F.max("n")).first()[0]
        if largest is None:
            break
        leads = LEADS_GROW**k
        salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
        chosen = F.pmod(F.xxhash64("node", "key"), F.ceil(F.col("n") / leads)) == 0
        x = open_.filter(chosen).select("key", F.col("node").alias("x"), F.col("wsum").alias("wa"), F.col("part").alias("px"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        y = open_.select("key", F.col("node").alias("y"), F.col("wsum").alias("wb"), F.col("part").alias("py"), F.pmod(F.xxhash64("node"), salts).cast("int").alias("salt"))
        new = x.join(y, ["key", "salt"]).filter("px <> py").filter(heavy).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        pairs = store.keep(new.join(seen, ["a", "b"], "left_anti"), f"pairs-{k}")
        near = store.keep(_verified(pairs, texts, idf_b, threshold), f"near-{k}")
        edges, seen = edges.union(near), seen.union(pairs)
        store.drop(f"open-{k}")
        if largest <= leads:
            break
    for name in ("member", "nodes", "wanted", "texts"):
        store.drop(name)
    return edges


def _groups(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(root, doc_id, version) of the texts in groups, and (root, lead, lead_version): the least of each group. `docs` has (doc_id, version, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    store = Store(spark, "neardup")
    docs = docs.filter("doc_id is not null and text is not null")
    df, n = document_frequencies(docs)
    idf_b = spark.sparkContext.broadcast(idf_table(df, n))
    sketch = docs.select("doc_id", "version", "text").mapInArrow(_sketcher(idf_b), "doc_id long, version long, fp1 long, fp2 long, wsum double, bands array<long>")
    sketch = store.keep(sketch.withColumn("node", F.monotonically_increasing_id()), "sketch")  # written, so a node's number stays
    copies = store.keep(sketch.groupBy("fp1", "fp2").agg(F.min("node").alias("rep"), F.count("*").alias("n")).filter("n > 1"), "copies")
    exact = store.keep(sketch.select("node", "fp1", "fp2").join(copies, ["fp1", "fp2"]).filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b")), "exact")
    edges = _edges(docs, sketch, exact, idf_b, threshold, store)
    root = _small(components(exact.union(edges)))
    member = store.keep(sketch.select("node", "doc_id", "version").join(root, "node").select("root", "doc_id", "version").distinct(), "groups")
    least = member.groupBy("root").agg(F.min(F.struct("doc_id", "version")).alias("l"))
    for name in ("sketch", "copies", "exact"):
        store.drop(name)
    return member, store.keep(least.select("root", F.col("l.doc_id").alias("lead"), F.col("l.version").alias("lead_version")), "leads")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, duplicate_of, group_size) of every document that isn't the least of its group.

    A row that repeats with its text counts once; a doc_id with several texts is in
    the groups of all of them, and `group_size` counts doc_ids.  Null doc_ids are
    left out.  A null or empty text, or one without a word, is in no group.
    Documents of equal shingles are exact copies whatever their punctuation and
    case.  A group's least doc_id stands for it, which settles ties.  Texts of any
    length are taken whole.  No rows give no rows.  Other columns are not read, so
    their names don't matter.
    """
    text = F.col("text").cast("string")
    member, lead = _groups(docs.select(F.col("doc_id").cast("long").alias("doc_id"), _version(text).alias("version"), text.alias("text")), threshold)
    ids = member.select("root", "doc_id").distinct()
    sizes = ids.groupBy("root").agg(F.count("*").alias("group_size"))
    return ids.join(lead, "root").join(sizes, "root").filter("doc_id <> lead").select("doc_id", F.col("lead").alias("duplicate_of"), "group_size").distinct()


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without the texts that repeat another; every group keeps that of its least doc_id (of one doc_id's, any one).

    Of rows that agree in doc_id and text one stays, the first by its JSON form.
    Texts in no group stay, null and empty ones too, and so do all rows without a
    doc_id.  Columns stay as they are, whatever their names; very long texts are
    compared whole.  No rows give no rows.
    """
    store = Store(spark, "neardup-stage")
    doc, version, row, gone_doc, gone_version = free(docs.columns, "doc", "version", "row", "gone_doc", "gone_version")
    text = F.col("text").cast("string")
    keyed = docs.withColumns({doc: F.col("doc_id").cast("long"), version: _version(text)})
    member, lead = _groups(keyed.select(F.col(doc).alias("doc_id"), F.col(version).alias("version"), text.alias("text")), THRESHOLD)
    same = (F.col("doc_id") == F.col("lead")) & (F.col("version") == F.col("lead_version"))
    gone = _small(store.keep(member.join(lead, "root").filter(~same).select(F.col("doc_id").alias(gone_doc), F.col("version").alias(gone_version)), "gone"))
    on = (F.col(doc) == F.col(gone_doc)) & (F.col(version) == F.col(gone_version))
    kept = keyed.join(gone, on, "left_anti")
    again = keyed.filter(F.col(doc).isNotNull()).groupBy(F.col(doc).alias(gone_doc), F.col(version).alias(gone_version)).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    again = store.keep(again, "again")
    if again.isEmpty():
        return kept.drop(doc, version)
    again = _small(again)
    order = Window.partitionBy(doc, version).orderBy(F.to_json(F.struct(*[column(c) for c in docs.columns])))
    first = kept.join(again, on, "left_semi").withColumn(row, F.row_number().over(order)).filter(F.col(row) == 1).drop(row)
    return kept.join(again, on, "left_anti").unionByName(first).drop(doc, version)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    """Groups by comparing all pairs that share a shingle, with counts of whole shingles: no sampling, no hashing."""
    spans = sorted([*bx.BETWEEN, *bx.ALONE])
    gaps = [(hi + 1, lo - 1) for (_, hi), (lo, _) in zip([(0, 0x7F), *spans], [*spans, (0x110000, 0)], strict=True)]
    of = lambda some: "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in some if lo <= hi)
    word = f"[{of(bx.ALONE)}]|[0-9a-z_{of(gaps)}]+"
    return f"""WITH RECURSIVE split_ AS (SELECT doc_id, regexp_extract_all(lower(text), '{word}') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
grams AS (SELECT doc_id, unnest(CASE WHEN len(w) >= {NGRAM} THEN list_transform(range(1, len(w) - {NGRAM} + 2), lambda i: array_to_string(w[i:i + {NGRAM - 1}], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM split_ WHERE len(w) > 0),
counted AS (SELECT doc_id, g, 1 + ln(count(*)) AS tf FROM grams GROUP BY doc_id, g),
df AS (SELECT g, count(*) AS df FROM counted GROUP BY g),
idf AS (SELECT g, ln(1 + 1 / (df / (SELECT count(*) FROM split_) + {IDF_SMOOTH})) AS idf FROM df WHERE df > 1),
alone AS (SELECT ln(1 + 1 / (1 / (SELECT count(*) FROM split_) + {IDF_SMOOTH})) AS idf),
total AS (SELECT doc_id, sum(tf * coalesce(i.idf, a.idf)) AS t FROM counted LEFT JOIN idf i USING (g), alone a GROUP BY doc_id),
shared AS (SELECT doc_id, g, tf * idf AS w FROM counted JOIN idf USING (g)),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, sum(least(a.w, b.w)) AS both_ FROM shared a JOIN shared b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM common JOIN total x ON x.doc_id = a JOIN total y ON y.doc_id = b WHERE both_ >= {THRESHOLD} * (x.t + y.t - both_)),
edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(n, r) AS (SELECT a, a FROM edges UNION SELECT e.b, x.r FROM reach x JOIN edges e ON e.a = x.n),
roots AS (SELECT n AS doc_id, min(r) AS duplicate_of FROM reach GROUP BY n)
SELECT doc_id, duplicate_of, count(*) OVER (PARTITION BY duplicate_of) AS group_size FROM roots QUALIFY doc_id <> duplicate_of"""


SQL = _sql()
