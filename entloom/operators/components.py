"""Connected components of a pair table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..store import Store

#: Up to so many edges (16 MB of long ids) are one task's work; more take rounds over the cluster. The result is the same.
SMALL_EDGES = 1_000_000


def least_roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and the least node each is connected to: roots are hooked to lesser ones and paths halved until no edge joins two roots."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(ends.ravel(), 2)
    root = np.arange(len(nodes))
    while len(a):
        x, y = root[a], root[b]
        open_ = x != y
        if not open_.any():
            break
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    batches = list(it)
    if not batches:
        return
    edges = pa.Table.from_batches(batches)
    kind = edges.schema.field("u").type
    node, root = least_roots(*(edges[c].to_numpy() for c in ("u", "v")))
    yield pa.RecordBatch.from_arrays([pa.array(node, kind), pa.array(root, kind)], ["node", "root"])


def components(pairs: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60, small: int = SMALL_EDGES) -> DataFrame:
    """(node, root) of every node that has a partner; root is the least node it is connected to.

    Nodes are of any type with an order.  Beyond `small` edges, large and small
    stars alternate: each round is one written table, so the plan doesn't grow with
    the rounds; least neighbours come from aggregates, which combine before the
    shuffle, so a hub of any degree is no task's burden.  Rounds grow with the
    logarithm of a chain's length.
    """
    store = Store(pairs.sparkSession, "components")
    edges = store.keep(pairs.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "0")
    kind = edges.schema["u"].dataType.simpleString()
    if edges.count() <= small:
        found = store.keep(edges.coalesce(1).mapInArrow(_in_one_task, f"node {kind}, root {kind}"), "roots")
        store.drop("0")
        return found
    before = None
    for k in range(1, most_rounds + 1):
        # large star: every greater neighbour u of v is tied to the least node around v
        around = edges.select(F.col("v").alias("x"), F.col("v").alias("m")).union(edges.select(F.col("u").alias("x"), "v"))
        least = around.groupBy("x").agg(F.min("m").alias("m"))
        hung = store.keep(edges.join(least, edges["v"] == least["x"]).select("u", F.col("m").alias("v")).distinct(), f"hung-{k}")
        # small star: u and its lesser neighbours are tied to the least of these
        least = hung.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
        more = hung.join(least.filter("n > 1"), hung["u"] == least["x"]).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store.keep(least.select(F.col("x").alias("u"), F.col("m").alias("v")).union(more).distinct(), str(k))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))).first()
        store.drop(str(k - 1))
        store.drop(f"hung-{k}")
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        before = now
    raise RuntimeError(f"components are still changing after {most_rounds} rounds")
