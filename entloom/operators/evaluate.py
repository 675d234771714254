"""Clusterings against gold labels: pairwise and BCubed precision, recall, F1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..store import Store
from .components import components
from .similarity import similar_links

MERGE_GRID, BORDERLINE_GRID = (0.78, 0.82, 0.86), (0.70, 0.75, 0.80)


def gold_duplicates(gold: DataFrame) -> DataFrame:
    """(doc_id, entity_id, n) of the entities with more than one gold row; must be empty."""
    return gold.groupBy("doc_id", "entity_id").agg(F.count("*").alias("n")).filter("n > 1")


def contingency(system: DataFrame, gold: DataFrame) -> DataFrame:
    """(s, g, n): entities that both have, by system and gold cluster. `system` is (doc_id, entity_id, cluster_id)."""
    both = system.filter("cluster_id is not null").join(gold, ["doc_id", "entity_id"])
    return both.groupBy(F.col("cluster_id").alias("s"), F.col("gold_cluster_id").alias("g")).agg(F.count("*").alias("n"))


def _f1(p: Column, r: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def pairwise_prf(table: DataFrame) -> DataFrame:
    """One row (precision, recall, f1) over pairs of entities, from counts alone.

    No entities: all 0; one: all 1; a share of no pairs is 1.
    """
    sums = table.groupingSets([[F.col("s"), F.col("g")], [F.col("s")], [F.col("g")], []], F.col("s"), F.col("g")).agg(F.sum("n").alias("n"), F.grouping_id().alias("of"))
    two = F.col("n") * (F.col("n") - 1) / 2
    t = sums.agg(*[F.coalesce(F.sum(F.when(F.col("of") == k, two)), F.lit(0.0)).alias(name) for k, name in ((0, "both"), (1, "sys"), (2, "gold"))], F.coalesce(F.max(F.when(F.col("of") == 3, F.col("n"))), F.lit(0)).alias("all"))
    p, r = (F.coalesce(F.try_divide("both", k), F.lit(1.0)) for k in ("sys", "gold"))
    t = t.select("all", p.alias("p"), r.alias("r"))
    some = F.col("all") > 0
    return t.select(F.when(some, F.col("p")).otherwise(0.0).alias("precision"), F.when(some, F.col("r")).otherwise(0.0).alias("recall"), F.when(some, _f1(F.col("p"), F.col("r"))).otherwise(0.0).alias("f1"))


def bcubed_prf(table: DataFrame) -> DataFrame:
    """One row (precision, recall, f1), averaged over entities; no entities: all 0."""
    s = table.groupBy("s").agg(F.sum("n").alias("ns"))
    g = table.groupBy("g").agg(F.sum("n").alias("ng"))
    t = table.join(s, "s").join(g, "g").agg(F.sum(F.col("n") * F.col("n") / F.col("ns")).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("ng")).alias("r"), F.sum("n").alias("all"))
    p, r = (F.coalesce(F.try_divide(k, "all"), F.lit(0.0)) for k in ("p", "r"))
    return t.select(p.alias("precision"), r.alias("recall")).withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def evaluate(system: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: both scores, and how many entities and clusters were compared."""
    table = contingency(system, gold)
    n = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"), F.count_distinct("s").alias("n_system_clusters"), F.count_distinct("g").alias("n_gold_clusters"))
    named = [df.select(*[F.col(c).alias(f"{name}_{c}") for c in df.columns]) for name, df in (("pairwise", pairwise_prf(table)), ("bcubed", bcubed_prf(table)))]
    return n.crossJoin(named[0]).crossJoin(named[1])


def sweep_thresholds(rows: DataFrame, gold: DataFrame, merge_grid: Sequence[float] = MERGE_GRID, borderline_grid: Sequence[float] = BORDERLINE_GRID) -> DataFrame:
    """Scores at every grid point with borderline <= merge, without a tie-breaker.

    Similarities are computed once, for all thresholds.  Without a tie-breaker
    the borderline decides nothing, so entities are clustered once for each merge
    threshold.  `rows` has (doc_id, entity_id, type, vector).
    """
    store = Store(rows.sparkSession, "sweep")
    e = rows.select("doc_id", "entity_id", "type", "vector", F.concat_ws("/", "doc_id", "entity_id").alias("node"))
    links = store.keep(similar_links(e, merge_grid), "links")
    out = None
    for level, merge in enumerate(merge_grid):
        root = components(links.filter(F.col("level") == level).select("a", "b"))
        system = e.join(root, "node", "left").select("doc_id", "entity_id", F.concat_ws("|", "type", F.coalesce("root", "node")).alias("cluster_id"))
        report = store.keep(evaluate(system, gold), f"report-{merge}")
        grid = [b for b in borderline_grid if b <= merge]
        if not grid:
            continue
        part = report.crossJoin(report.sparkSession.createDataFrame([(float(merge), float(b)) for b in grid], "merge_threshold double, borderline_threshold double"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no grid point has borderline <= merge")
    return out


def best_point(sweep: DataFrame) -> DataFrame:
    """The grid point of the best pairwise F1; of equal ones the first in grid order."""
    return sweep.orderBy(F.desc("pairwise_f1"), "merge_threshold", "borderline_threshold").limit(1)
