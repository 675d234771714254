"""Hierarchical packing into context windows of several lengths (operator 3).

Documents are routed to the shortest context that holds them; a document longer
than the longest context is cut into pieces of that length, none of it is lost.
Pieces are spread over shards by hash, and each shard packs on its own: tier by
tier from the longest, best fit decreasing; what a long window has left is filled
with the largest pieces of shorter tiers that fit; what remains of these is packed
in their own tier.  Windows of a tier are then dealt to step groups so that the
groups have nearly the same attention cost.  Only ids and lengths are moved.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import tokens as tk
from .store import Store

TIERS = (512, 2048, 8192)
#: Pieces of a shard, on average; a shard leaves at most a few windows half full.
SHARD_PIECES = 20_000
#: Windows of each tier in a step group: the same number of tokens a step.
GROUP_WINDOWS = {512: 64, 2048: 16, 8192: 4}

_SCHEMA = "doc_id long, piece int, piece_start long, length int, context int, shard int, window int, position int, step_group int"


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> tuple[list[int], list[int], list[int]]:
    """Context, window (numbered in its tier) and position of every piece; `lengths` must not increase.

    Ties go to the earlier piece, and to the earlier of windows that have the same room.
    """
    n = len(lengths)
    context, window, position = [0] * n, [0] * n, [0] * n
    placed = [False] * n
    # pieces by length, shortest first; of one length the earliest last, so that it is taken first
    left = list(range(n - 1, -1, -1))
    size = [lengths[i] for i in left]

    def put(i: int, tier: int, w: int, at: int) -> None:
        context[i], window[i], position[i], placed[i] = tier, w, at, True

    for k in range(len(tiers) - 1, -1, -1):
        tier, under = tiers[k], tiers[k - 1] if k else 0
        first = bisect_right(size, under)
        own = left[first:][::-1]
        del left[first:], size[first:]
        used: list[int] = []
        room: list[tuple[int, int]] = []  # (room, window), least room first
        for i in own:
            at = bisect_left(room, (lengths[i], -1))
            if at == len(room):
                w = len(used)
                used.append(0)
            else:
                w = room.pop(at)[1]
            put(i, tier, w, used[w])
            used[w] += lengths[i]
            if used[w] < tier:
                insort(room, (tier - used[w], w))
        for free, w in sorted(room, key=lambda r: (-r[0], r[1])):
            while size and size[0] <= free:
                at = bisect_right(size, free) - 1
                i = left.pop(at)
                size.pop(at)
                put(i, tier, w, used[w])
                used[w] += lengths[i]
                free -= lengths[i]
    return context, window, position


def step_groups(cost: np.ndarray, windows: int) -> np.ndarray:
    """Group of each window: windows by falling cost, dealt to and fro over the groups."""
    n = len(cost)
    groups = -(-n // windows)
    order = np.lexsort((np.arange(n), -cost))
    turn, seat = np.divmod(np.arange(n), groups)
    out = np.empty(n, dtype=np.int64)
    out[order] = np.where(turn % 2 == 0, seat, groups - 1 - seat)
    return out


def _pack_shard(table: pa.Table) -> pa.Table:
    known = table["doc_id"].is_valid().to_numpy()
    doc = table["doc_id"].fill_null(0).to_numpy()
    piece, start, length, shard = (table[c].to_numpy() for c in ("piece", "piece_start", "length", "shard"))
    order = np.lexsort((piece, doc, ~known, -length))
    sizes = length[order]
    context, window, position = (np.array(x, dtype=np.int64) for x in pack(sizes.tolist()))
    group = np.zeros(len(order), dtype=np.int64)
    for tier in TIERS:
        at = np.flatnonzero(context == tier)
        if len(at):
            cost = np.bincount(window[at], sizes[at].astype(float) ** 2)
            group[at] = step_groups(cost, GROUP_WINDOWS[tier])[window[at]]
    ids = pa.array(doc[order], pa.int64(), mask=~known[order])
    return pa.Table.from_arrays([ids, *(pa.array(x, t) for x, t in ((piece[order], pa.int32()), (start[order], pa.int64()), (sizes, pa.int32()), (context, pa.int32()), (shard[order], pa.int32()), (window, pa.int32()), (position, pa.int32()), (group, pa.int32())))], [f.split()[0] for f in _SCHEMA.split(", ")])


def packed(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """Where every piece of every document lies.

    One row a piece: (doc_id, piece, piece_start, length) say which tokens they
    are; (context, shard, window, position) where they go; windows of one
    (context, shard, step_group) make a step.  Rows without tokens (null or empty
    text) have no piece.  Rows that repeat are packed as often as they come; null
    doc_ids are packed too.  Of equal lengths the lesser doc_id goes first.  No rows
    give no rows.  Columns but doc_id and text are not read, so their names don't
    matter.
    """
    spark = docs.sparkSession
    store = Store(spark, "packing")
    n = tk.counted_once(F.col("text")) if tokens is None else tokens.cast("long")
    longest = TIERS[-1]
    counts = store.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), n.alias("n")).filter("n > 0"), "lengths")
    total = counts.agg(F.sum(F.ceil(F.col("n") / longest))).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_PIECES))
    pieces = counts.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / longest).cast("int"))))
    start = F.col("piece").cast("long") * longest
    pieces = pieces.select("doc_id", "piece", start.alias("piece_start"), F.least(F.col("n") - start, F.lit(longest)).cast("int").alias("length"))
    pieces = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(shards)).cast("int"))
    return pieces.groupBy("shard").applyInArrow(_pack_shard, _SCHEMA)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of `docs` lies, its columns those of :func:`packed`; the last stage of the pipeline."""
    return packed(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
