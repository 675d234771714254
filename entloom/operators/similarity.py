"""Exact similarity joins of vectors, as block products.

Vectors of a kind are dealt to blocks, and each block is packed into one row of a
stored table: the only time that vectors are moved.  The pairs of blocks are a
Cartesian product of that table's splits, which rereads it and shuffles nothing, so
what is shuffled and written grows with the number of vectors, not with its square.
Similarities of a pair of blocks are one matrix product.  Nothing of the size of the
square of a kind is ever held, and a skewed kind is spread like any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Store
from .components import least_roots

BLOCK = 2048
#: Bytes of packed blocks in a split of the stored table; a task holds a split of each side.
SPLIT_BYTES = 16 << 20
#: Edges of a task from which they are brought down to a forest.
FOREST_EDGES = 2_000_000


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(len(flat), -1)


def _packed(df: DataFrame, kind: str, node: Column, vector: Column, own: Column | None = None) -> tuple[DataFrame, int]:
    """(kind, block, blocks, ids, own, v), a row for each block, with its kind's number of blocks; and the most blocks of a kind."""
    rows = df.select(F.col(kind).alias("kind"), node.alias("node"), (F.lit(None).cast("string") if own is None else own).alias("own"), vector.cast("array<double>").alias("v"))
    sizes = rows.groupBy("kind").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"), F.max(F.size("v")).alias("dim"))
    total, most, dim = sizes.agg(F.sum("blocks"), F.max("blocks"), F.max("dim")).first()
    rows = rows.join(F.broadcast(sizes.drop("dim")), "kind").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        listed = [pa.ListArray.from_arrays(pa.array([0, len(table)], pa.int32()), pa.concat_arrays(table[c].chunks)) for c in ("node", "own")]
        first = [table[c].slice(0, 1) for c in ("kind", "block", "blocks")]
        return pa.table([*first, *listed, pa.array([_matrix(table["v"]).tobytes()], pa.binary())], ["kind", "block", "blocks", "ids", "own", "v"])

    of = {f.name: f.dataType.simpleString() for f in rows.schema}
    packed = rows.groupBy("kind", "block").applyInArrow(pack, f"kind {of['kind']}, block int, blocks int, ids array<{of['node']}>, own array<string>, v binary")
    if (most or 0) > 1:
        spark = df.sparkSession
        splits = max(math.ceil(2 * math.sqrt(spark.sparkContext.defaultParallelism)), math.ceil(total * BLOCK * dim * 8 / SPLIT_BYTES))
        packed = Store(spark, "blocks").keep(packed.repartition(min(splits, total)), "packed")
    return packed, most or 0


def _side(packed: DataFrame, name: str) -> DataFrame:
    return packed.select(*[F.col(c).alias(f"{c}_{name}") for c in ("kind", "block", "ids", "own", "v")])


def _products(left: DataFrame, right: DataFrame, only: Column | None = None) -> DataFrame:
    """Pairs of blocks of one kind."""
    same = F.col("kind_a") == F.col("kind_b")
    return _side(left, "a").hint("shuffle_replicate_nl").join(_side(right, "b"), same if only is None else same & only)


def _block_pairs(vectors: DataFrame, kind: str, node: str, vector: str) -> DataFrame:
    """Each block alone (the second half is null), and each two of a kind."""
    packed, most = _packed(vectors, kind, F.col(node), F.col(vector))
    none = [F.lit(None).cast(t).alias(f"{c}_b") for c, t in packed.select("kind", "block", "ids", "own", "v").dtypes]
    alone = _side(packed, "a").select("*", *none)
    if most < 2:
        return alone
    several = packed.filter("blocks > 1")
    return alone.unionByName(_products(several, several, F.col("block_a") < F.col("block_b")))


def _of(row: dict[str, pa.Array], name: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    ids = row[f"ids_{name}"][k].values.to_numpy(zero_copy_only=False)
    return ids, np.frombuffer(row[f"v_{name}"][k].as_buffer(), dtype=np.float64).reshape(len(ids), -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, pa.Array], int]]:
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        for k in range(len(batch)):
            yield columns, k


def _above(v: np.ndarray, w: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of v, rows of w and the products that reach the threshold, for some rows of v at a time."""
    for lo in range(0, len(v), 512):
        s = v[lo : lo + 512] @ w.T
        x, y = np.nonzero(s >= threshold)
        yield x + lo, y, s[x, y]


def similar_pairs(vectors: DataFrame, threshold: float, kind: str = "type", node: str = "node", vector: str = "vector") -> DataFrame:
    """(kind, a, b, similarity) of all pairs a < b of one kind whose dot product is at least the threshold."""
    name = vectors.schema[node].dataType.simpleString()
    kind_type = vectors.schema[kind].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, k in _rows(batches):
            ids, v = _of(row, "a", k)
            alone = not row["v_b"][k].is_valid
            others, w = (ids, v) if alone else _of(row, "b", k)
            for x, y, s in _above(v, w, threshold):
                a, b = ids[x], others[y]
                keep = a < b if alone else a != b
                a, b, s = a[keep], b[keep], s[keep]
                swap = a > b
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                node_type = row["ids_a"].type.value_type
                yield pa.RecordBatch.from_arrays([pa.array([row["kind_a"][k].as_py()] * len(s), row["kind_a"].type), pa.array(a.tolist(), node_type), pa.array(b.tolist(), node_type), pa.array(s, pa.float64())], [kind, "a", "b", "similarity"])

    return _block_pairs(vectors, kind, node, vector).mapInArrow(run, f"{kind} {kind_type}, a {name}, b {name}, similarity double")


def similar_links(vectors: DataFrame, thresholds: Sequence[float], kind: str = "type", node: str = "node", vector: str = "vector") -> DataFrame:
    """(level, a, b): links that connect the same nodes as all pairs of :func:`similar_pairs` at each threshold, level being its index.

    Each task brings its pairs down to a forest: it gives fewer links than it has
    nodes, however many its pairs.
    """
    name = vectors.schema[node].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, tuple[int, np.ndarray]] = {}
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in thresholds]
        held = [0] * len(thresholds)
        size, node_type = 0, None

        def first(key: tuple, ids: np.ndarray) -> int:
            nonlocal size
            if key not in known:
                known[key] = size, ids.copy()
                size += len(ids)
            return known[key][0]

        def forest(level: int) -> None:
            u, v = (np.concatenate(x) for x in zip(*found[level], strict=True))
            at, root = least_roots(u, v)
            found[level] = [(root[at != root], at[at != root])]
            held[level] = len(found[level][0][0])

        for row, k in _rows(batches):
            node_type = row["ids_a"].type.value_type
            ids, v = _of(row, "a", k)
            alone = not row["v_b"][k].is_valid
            others, w = (ids, v) if alone else _of(row, "b", k)
            key = row["kind_a"][k].as_py()
            at = first((key, row["block_a"][k].as_py()), ids)
            to = at if alone else first((key, row["block_b"][k].as_py()), others)
            for x, y, s in _above(v, w, min(thresholds)):
                for level, t in enumerate(thresholds):
                    use = (s >= t) & (x < y) if alone else s >= t
                    found[level].append((x[use] + at, y[use] + to))
                    held[level] += int(use.sum())
                    if held[level] > FOREST_EDGES + size:
                        forest(level)
        if not size:
            return
        names = np.concatenate([ids for _, ids in known.values()])
        for level in range(len(thresholds)):
            forest(level)
            (a, b), *_ = found[level]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), level), pa.int32()), pa.array(names[a].tolist(), node_type), pa.array(names[b].tolist(), node_type)], ["level", "a", "b"])

    return _block_pairs(vectors, kind, node, vector).mapInArrow(run, f"level int, a {name}, b {name}")


def _two(s: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, codes and products of the best of each row, then of the second; a tie goes to the lesser code, and what isn't finite is none."""
    every = np.arange(len(s))
    for _ in range(2 if s.shape[1] else 0):
        best = s.max(axis=1)
        k = np.where(s == best[:, None], code, np.iinfo(np.int64).max).argmin(axis=1)
        ok = np.isfinite(best)
        yield every[ok], code[every, k][ok], best[ok]
        s[every, k] = -np.inf


def best_two(left: DataFrame, right: DataFrame, kind: str = "type") -> DataFrame:
    """(node, first, first_similarity, second_similarity): the two best of `right` for each of `left` in its kind.

    `left` has (kind, node, vector, own), `right` (kind, target, vector); a target
    that equals `own` is left out.  A tie goes to the lesser target.  Where there is
    no second, it is null; a node without any target has no row.
    """
    lefts, some = _packed(left, kind, F.col("node").cast("string"), F.col("vector"), F.col("own").cast("string"))
    rights, others = _packed(right, kind, F.col("target").cast("string"), F.col("vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names = None, None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def told() -> Iterator[pa.RecordBatch]:
            """The best two of the left block's nodes among the right blocks that were met."""
            if not found:
                return
            targets, code = np.unique(np.concatenate([t for _, t, _ in found]), return_inverse=True)
            at, s = np.concatenate([i for i, _, _ in found]), np.concatenate([s for _, _, s in found])
            order = np.lexsort((code, -s, at))
            at, code, s = at[order], code[order], s[order]
            keep = np.arange(len(at)) - np.searchsorted(at, at) < 2
            yield pa.RecordBatch.from_arrays([pa.array(names[at[keep]].tolist(), pa.string()), pa.array(targets[code[keep]].tolist(), pa.string()), pa.array(s[keep], pa.float64())], ["node", "target", "s"])

        for row, k in _rows(batches):
            ids, v = _of(row, "a", k)
            this = row["kind_a"][k].as_py(), row["block_a"][k].as_py()
            if this != key:
                yield from told()
                key, names, found = this, ids.copy(), []
            targets, w = _of(row, "b", k)
            order = np.argsort(targets, kind="stable")
            targets, w = targets[order], w[order]
            place: dict[str, int] = {}
            code = np.array([place.setdefault(t, len(place)) for t in targets], dtype=np.int64)
            own = np.array([place.get(o, -1) for o in row["own_a"][k].as_py()], dtype=np.int64)
            least = np.array(list(place), dtype=object)
            for lo in range(0, len(ids), 512):
                s = v[lo : lo + 512] @ w.T
                s[own[lo : lo + 512, None] == code[None, :]] = -np.inf
                found += [(i + lo, least[c], best) for i, c, best in _two(s, np.broadcast_to(code, s.shape))]
        yield from told()

    if max(some, others) < 2:
        pairs = _side(lefts, "a").join(_side(rights, "b"), F.col("kind_a") == F.col("kind_b"))
    else:
        pairs = _products(lefts, rights)
    found = pairs.mapInArrow(run, "node string, target string, s double")
    two = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("k"), "target", "s"))), 1, 2).alias("top")
    ranked = found.groupBy("node").agg(two)
    return ranked.select("node", F.get("top", F.lit(0))["target"].alias("first"), F.get("top", F.lit(0))["s"].alias("first_similarity"), F.get("top", F.lit(1))["s"].alias("second_similarity"))
