"""Resolution of new entities against a registry, in order.

The fold is sequential within a type (each entity sees the clusters that earlier
ones made) and parallel over types.  Clusters that were there before keep their
centroids during a run; centroids of new clusters move with every entity.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..backends import TieBreaker, checked_merges
from ..functions import ids
from ..functions.vectors import FLOOR
from ..store import Store
from .centroids import update_centroids
from .cluster import BORDERLINE, MERGE, apply_assignments, numbered, with_contexts
from .similarity import best_two

_OUT = "doc_id string, entity_id string, cluster_id string, top_similarity double, second_similarity double, source string, is_new boolean, new_canonical string, centroid array<double>, size int"


@dataclass
class Incremental:
    assignments: DataFrame
    entities: DataFrame
    registry: DataFrame
    centroids: DataFrame


def new_cluster_id(kind: str, canonical: str, doc_id: str, taken: set[str]) -> str:
    """As for a cluster of one document; an id that is taken gets _1, _2 and so on."""
    base = "c_" + hashlib.sha1(f"{kind}|{canonical}|{doc_id}".encode()).hexdigest()[:10]
    found, k = base, 0
    while found in taken:
        k += 1
        found = f"{base}_{k}"
    return found


def _unit(v: np.ndarray) -> np.ndarray:
    return v / max(float(np.sqrt(v @ v)), FLOOR)


def _listed(values) -> list:
    return [] if values is None else list(values)


def fold(kind: str, new: list[dict], old: list[dict], tiebreaker: TieBreaker | None, merge: float, borderline: float) -> list[dict]:
    """Assignments of the new entities of one type, in their order, with all old clusters at hand."""
    m = np.array([c["centroid"] for c in old], dtype=np.float64)
    near = []
    for e in new:
        s = m @ np.asarray(e["vector"], dtype=np.float64) if len(old) else np.zeros(0)
        best = [(old[int(k)], float(s[k])) for k in np.argsort(-s, kind="stable")[:2]]
        first = {"nearest": best[0][0]["cluster_id"], "nearest_canonical": best[0][0]["canonical"], "first_similarity": best[0][1]} if best else {}
        near.append(e | first | {"second_similarity": best[1][1] if len(best) > 1 else None, "taken": [c["cluster_id"] for c in old]})
    return fold_near(kind, near, tiebreaker, merge, borderline)


def fold_near(kind: str, new: list[dict], tiebreaker: TieBreaker | None, merge: float, borderline: float) -> list[dict]:
    """Assignments of the new entities of one type, in their order.

    Each has its `nearest` old cluster with `nearest_canonical` and
    `first_similarity`, the `second_similarity` of the next, and the old ids that
    are `taken` of those that it could get.
    """
    fresh: dict[str, dict] = {}
    taken: set[str] = set()
    made: list[str] = []  # ids of the new clusters, in order; their centroids are the first rows of new_m
    new_m = np.zeros((64, len(new[0]["vector"]) if new else 0))
    out: list[dict] = []
    waiting: list[dict] = []

    def register(e: dict, v: np.ndarray) -> str:
        nonlocal new_m
        cid = new_cluster_id(kind, e["canonical"], e["doc_id"], taken.union(_listed(e.get("taken"))))
        taken.add(cid)
        fresh[cid] = {"centroid": v, "n": 1, "canonical": e["surface_canonical"], "members": [len(out)]}
        if len(made) == len(new_m):
            new_m = np.concatenate([new_m, np.zeros_like(new_m)])
        new_m[len(made)] = v
        made.append(cid)
        return cid

    for e in new:
        v = np.asarray(e["vector"], dtype=np.float64)
        has_old = isinstance(e.get("nearest"), str)
        old_s = [float(s) for s in (e.get("first_similarity"), e.get("second_similarity")) if has_old and s is not None and s == s]
        new_s = new_m[: len(made)] @ v
        every = np.concatenate([old_s, new_s])
        second = float(np.partition(every, len(every) - 2)[-2]) if len(every) > 1 else 0.0
        best_old = old_s[0] if has_old else -1.0
        best_new = float(new_s.max()) if len(new_s) else -1.0
        row = {"doc_id": e["doc_id"], "entity_id": e["entity_id"], "top_similarity": 1.0, "second_similarity": second, "source": "singleton", "vector": v, "surface": e["surface_canonical"]}
        if has_old and best_old >= merge and best_old >= best_new:
            row |= {"cluster_id": e["nearest"], "top_similarity": best_old, "source": "threshold"}
        elif len(new_s) and best_new >= merge:
            at = int(new_s.argmax())
            cid = made[at]
            c = fresh[cid]
            # the running mean of unit vectors, kept at unit length
            c["centroid"] = new_m[at] = _unit((c["centroid"] * c["n"] + v) / (c["n"] + 1))
            c["n"] += 1
            c["members"].append(len(out))
            if len(e["surface_canonical"]) > len(c["canonical"]):
                c["canonical"] = e["surface_canonical"]
            row |= {"cluster_id": cid, "top_similarity": best_new, "source": "threshold"}
        elif tiebreaker is not None and has_old and best_old >= borderline:
            row |= {"cluster_id": register(e, v), "top_similarity": best_old}
            waiting.append({"at": len(out), "entity": e, "nearest": e["nearest"], "similarity": best_old})
        else:
            row["cluster_id"] = register(e, v)
        out.append(row)

    if waiting:
        names = {w["nearest"]: w["entity"]["nearest_canonical"] for w in waiting}
        asked = [{"entity_id": f"{w['entity']['doc_id']}/{w['entity']['entity_id']}", "type": kind, "canonical": w["entity"]["canonical"], "contexts": _listed(w["entity"].get("contexts")), "nearest_cluster_id": w["nearest"], "nearest_similarity": w["similarity"]} for w in waiting]
        by_ref = {a["entity_id"]: w for a, w in zip(asked, waiting, strict=True)}
        for m in checked_merges(tiebreaker.decide(asked, names), list(by_ref), names):
            w = by_ref[m.entity_id]
            if m.target != w["nearest"]:
                continue  # only the nearest cluster was offered
            row = out[w["at"]]
            left = fresh[row["cluster_id"]]
            left["members"].remove(w["at"])
            if left["members"]:
                # others have joined the provisional cluster: it lives on, without this entity
                left["centroid"] = _unit(sum(out[i]["vector"] for i in left["members"]))
                left["n"] = len(left["members"])
                left["canonical"] = max((out[i]["surface"] for i in left["members"]), key=len)
            else:
                del fresh[row["cluster_id"]]
            row |= {"cluster_id": w["nearest"], "top_similarity": w["similarity"], "source": "llm_tiebreak"}
    for row in out:
        c = fresh.get(row["cluster_id"])
        row |= {"is_new": c is not None, "new_canonical": c["canonical"] if c else None, "centroid": c["centroid"].tolist() if c else None, "size": c["n"] if c else None}
    return out


def assign(new: DataFrame, centroids: DataFrame, registry: DataFrame, tiebreaker: TieBreaker | None = None, merge: float = MERGE, borderline: float = BORDERLINE) -> DataFrame:
    """The fold over each type. `new` has vectors; clusters that the registry doesn't know are left out.

    Old centroids don't move during a run, so each entity's best two of them are
    found before, in block products over the cluster; the task of a type holds its
    new entities alone, however large the registry is.
    """
    known = centroids.drop("type").join(registry.select("cluster_id", "type", "canonical"), "cluster_id")
    order = numbered(new).select("type", "node", "doc_id", "entity_id", "canonical", "surface_canonical", F.col("vector").cast("array<double>").alias("vector"), F.col("rank.o").alias("o"), F.col("rank.d").alias("d"), F.col("rank.s").alias("s"), *(["contexts"] if "contexts" in new.columns else []))
    left = order.select("type", "node", "vector", F.lit(None).cast("string").alias("own"))
    near = best_two(left, known.select("type", F.col("cluster_id").alias("target"), F.col("centroid").alias("vector")))
    near = near.join(known.select(F.col("cluster_id").alias("first"), F.col("canonical").alias("nearest_canonical")), "first").withColumnRenamed("first", "nearest")
    # of a new cluster's id only one that was made from the same name and document can be taken
    taken = registry.select(F.regexp_extract("cluster_id", "^(c_[0-9a-f]{10})(?:_[0-9]+)?$", 1).alias("own_id"), "cluster_id").filter("own_id <> ''").groupBy("own_id").agg(F.collect_set("cluster_id").alias("taken"))
    rows = order.join(near, "node", "left").withColumn("own_id", ids.cluster_id(F.col("type"), F.col("canonical"), F.array("doc_id"))).join(taken, "own_id", "left").drop("own_id", "node")

    def run(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in _OUT.split(", ")]
        ordered = table.sort_values(["o", "d", "s", "entity_id"], kind="stable").to_dict("records")
        frame = pd.DataFrame(fold_near(key[0], ordered, tiebreaker, merge, borderline), columns=columns)
        frame["size"] = frame["size"].astype("Int32")
        return frame

    return rows.groupBy("type").applyInPandas(run, _OUT)


def resolve_incremental(new: DataFrame, registry: DataFrame, centroids: DataFrame, embedder_id: str, tiebreaker: TieBreaker | None = None, merge: float = MERGE, borderline: float = BORDERLINE, docs: DataFrame | None = None) -> Incremental:
    """New entities placed; the merged registry; the updated centroids.

    Given the documents, a tie-breaker gets the contexts of the entities' first
    mentions.  Centroids of another embedder are an error.
    """
    other = [r.embedder_id for r in centroids.select("embedder_id").distinct().collect() if r.embedder_id != embedder_id]
    if other:
        raise ValueError(f"centroids are of embedder {other[0]}, vectors of {embedder_id}")
    store = Store(new.sparkSession, "incremental")
    asked = with_contexts(new, docs) if tiebreaker is not None else new
    found = store.keep(assign(asked, centroids, registry, tiebreaker, merge, borderline), "assignments")
    entities = store.keep(apply_assignments(new, found), "entities")

    grown = numbered(entities.join(found.filter("not is_new").select("doc_id", "entity_id"), ["doc_id", "entity_id"], "left_semi"))
    additions = grown.select("cluster_id", "vector")
    kinds = entities.groupBy("cluster_id").agg(F.max("type").alias("type"))
    fresh = found.filter("is_new").groupBy("cluster_id").agg(F.first("centroid").alias("centroid"), F.first("size").alias("size"), F.first("new_canonical").alias("canonical")).join(kinds, "cluster_id")
    added = numbered(entities).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "node"))).alias("ms"), F.min(F.struct((-F.length("surface_canonical")).alias("k"), "rank", F.col("surface_canonical").alias("s"))).alias("best"))
    added = added.select("cluster_id", F.transform("ms", lambda m: m["node"]).alias("more"), F.col("best.s").alias("longest"))
    old = registry.join(added, "cluster_id", "left")
    longer = F.length("longest") > F.length("canonical")
    merged = old.select("cluster_id", F.when(longer, F.col("longest")).otherwise(F.col("canonical")).alias("canonical"), "type", F.concat("members", F.coalesce("more", F.array().cast("array<string>"))).alias("members"))
    made = fresh.join(added, "cluster_id").select("cluster_id", "canonical", "type", F.col("more").alias("members"))
    updated = update_centroids(centroids, additions, fresh, embedder_id)
    return Incremental(found.select("doc_id", "entity_id", "cluster_id", "top_similarity", "second_similarity", "source"), entities, store.keep(merged.unionByName(made), "registry"), store.keep(updated, "centroids"))
