import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entloom.backends import FirstLetterEmbedder, HashedEmbedder, NearestTieBreaker
from entloom.operators import centroids, cluster, evaluate
from entloom.operators.components import components
from entloom.operators.incremental import fold, new_cluster_id, resolve_incremental
from entloom.operators.similarity import best_two, similar_links, similar_pairs

ROW = "doc_id string, entity_id string, type string, canonical string, surface_canonical string, confidence double, cluster_id string, vector array<double>, ord int"


def entities(spark, rows, kind="T"):
    """rows: (doc, name, vector[, type])."""
    data = [(r[0], f"e{k}", r[3] if len(r) > 3 else kind, r[1], r[1], 0.9, None, [float(x) for x in r[2]], k) for k, r in enumerate(rows)]
    return spark.createDataFrame(data, ROW)


def unit(*v):
    v = np.array(v, dtype=float)
    return (v / np.linalg.norm(v)).tolist()


def brute_components(pairs):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), max_size=30))
def test_components_property(spark, pairs):
    df = spark.createDataFrame(pairs, "a int, b int")
    assert {r.node: r.root for r in components(df).collect()} == brute_components(pairs)


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)]
    df = spark.createDataFrame(pairs, "a int, b int")
    assert {r.node: r.root for r in components(df).collect()} == brute_components(pairs)


def test_pairs_and_best_two_match_numpy(spark, monkeypatch):
    import entloom.operators.similarity as s

    monkeypatch.setattr(s, "BLOCK", 7)  # several blocks, so that all kinds of block pairs occur
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 5))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    kinds = [str(k % 2) for k in range(40)]
    df = spark.createDataFrame([(kinds[k], f"n{k:02d}", v[k].tolist()) for k in range(40)], "type string, node string, vector array<double>")
    got = {(r.a, r.b): r.similarity for r in similar_pairs(df, 0.4).collect()}
    want = {(f"n{a:02d}", f"n{b:02d}"): v[a] @ v[b] for a in range(40) for b in range(a + 1, 40) if kinds[a] == kinds[b] and v[a] @ v[b] >= 0.4}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    right = df.filter("node < 'n20'").select("type", F.col("node").alias("target"), "vector")
    found = {r.node: r for r in best_two(df.withColumn("own", F.col("node")), right).collect()}
    for k in range(40):
        sims = sorted(((v[k] @ v[j], f"n{j:02d}") for j in range(20) if kinds[j] == kinds[k] and j != k), reverse=True)
        assert found[f"n{k:02d}"].first == sims[0][1] and abs(found[f"n{k:02d}"].second_similarity - sims[1][0]) < 1e-12


def _blocked(spark, monkeypatch):
    """60 vectors of two kinds in blocks of 7, many of them alike."""
    import entloom.operators.similarity as s

    monkeypatch.setattr(s, "BLOCK", 7)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 4))
    v[::3] = v[0] + 0.01 * v[::3]
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(str(k % 2), f"n{k:02d}", v[k].tolist()) for k in range(60)], "type string, node string, vector array<double>")


def test_block_pairs_shuffle_nothing(spark, monkeypatch):
    """Vectors were once shuffled to each pair of blocks: the square of their number."""
    _, df = _blocked(spark, monkeypatch)
    for found in (similar_pairs(df, 0.4), similar_links(df, [0.4])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan


def test_links_connect_what_pairs_connect(spark, monkeypatch):
    import entloom.operators.similarity as s

    v, df = _blocked(spark, monkeypatch)
    for most in (s.FOREST_EDGES, -1000):  # with the second, a forest after each product
        monkeypatch.setattr(s, "FOREST_EDGES", most)
        links = similar_links(df, [0.8, 0.95]).collect()
        for level, t in enumerate((0.8, 0.95)):
            pairs = [(f"n{a:02d}", f"n{b:02d}") for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and v[a] @ v[b] >= t]
            got = [(r.a, r.b) for r in links if r.level == level]
            assert brute_components(got) == brute_components(pairs)
    spot = spark.createDataFrame([("T", f"n{k}", [1.0, 0.0]) for k in range(50)], "type string, node string, vector array<double>")
    monkeypatch.setattr(s, "BLOCK", 64)
    assert similar_links(spot, [0.4]).count() == 49  # not all 1,225 pairs


def test_same_name_clusters_and_types_block(spark):
    e = entities(spark, [("d1", "Al", (1, 0)), ("d2", "Alan", (1, 0)), ("d3", "Al", (1, 0)), ("d4", "Bo", (0, 1)), ("d5", "Al", (1, 0), "U"), ("d6", "Al", (1, 0), "U")])
    r = cluster.resolve(e)
    a = {x.entity_id: x for x in r.assignments.collect()}
    assert len({a[k].cluster_id for k in ("e0", "e1", "e2")}) == 1 and a["e4"].cluster_id == a["e5"].cluster_id != a["e0"].cluster_id
    assert a["e3"].source == "singleton" and a["e3"].top_similarity == 1.0
    assert a["e0"].top_similarity == pytest.approx(1.0) and a["e0"].second_similarity == 0.0
    tagged = cluster.apply_assignments(e, r.assignments)
    reg = {x.cluster_id: x for x in cluster.registry(tagged).collect()}
    assert reg[a["e0"].cluster_id].canonical == "Alan" and reg[a["e0"].cluster_id].members == ["d1/e0", "d2/e1", "d3/e2"]
    assert tagged.filter("entity_id = 'e0'").first().confidence == pytest.approx(0.4 * 0.9 + 0.4 + 0.2)


def test_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    e = entities(spark, [(f"d{k}", f"n{k}", unit(*rng.normal(size=3))) for k in range(30)])
    key = lambda df: sorted((x.entity_id, x.cluster_id, round(x.top_similarity, 9)) for x in cluster.resolve(df).assignments.collect())
    assert key(e) == key(e.orderBy(F.desc("ord")).repartition(3))


def test_tie_break(spark):
    near = unit(0.78, np.sqrt(1 - 0.78**2))
    e = entities(spark, [("d1", "A", (1, 0)), ("d2", "A", (1, 0)), ("d3", "B", near)])
    plain = {x.entity_id: x for x in cluster.resolve(e).assignments.collect()}
    assert plain["e2"].source == "singleton"
    found = cluster.resolve(e, NearestTieBreaker())
    with_ = {x.entity_id: x for x in found.assignments.collect()}
    assert with_["e2"].source == "llm_tiebreak" and with_["e2"].cluster_id == with_["e0"].cluster_id and found.candidates.count() == 1
    assert cluster.apply_assignments(e, found.assignments).filter("entity_id = 'e2'").first().confidence == pytest.approx(0.36 + 0.36 + 0.2 * 0.78)
    assert {x.entity_id: x.source for x in cluster.resolve(e, NearestTieBreaker(0.99)).assignments.collect()}["e2"] == "singleton"


def test_empty(spark):
    e = entities(spark, [("d", "A", (1, 0))]).limit(0)
    assert cluster.resolve(e, NearestTieBreaker()).assignments.count() == 0 and cluster.registry(e).count() == 0


def test_centroids(spark):
    e = entities(spark, [("d1", "A", (1, 0)), ("d2", "A", (1, 0)), ("d3", "B", (0, 1))]).withColumn("cluster_id", F.when(F.col("ord") < 2, "c1").otherwise("c2"))
    c = centroids.compute_centroids(e, "x")
    assert {r.cluster_id: (r.size, list(r.centroid)) for r in c.collect()} == {"c1": (2, [1.0, 0.0]), "c2": (1, [0.0, 1.0])}
    add = spark.createDataFrame([("c1", [0.0, 1.0])], "cluster_id string, vector array<double>")
    none = c.limit(0)
    r = centroids.update_centroids(c, add, none, "x").filter("cluster_id = 'c1'").first()
    assert r.size == 3 and list(r.centroid) == pytest.approx(unit(2, 1))
    fresh = c.withColumn("cluster_id", F.concat(F.lit("n"), "cluster_id"))
    assert sorted(r.cluster_id for r in centroids.update_centroids(c, add.limit(0), fresh, "x").collect()) == ["c1", "c2", "nc1", "nc2"]
    for bad in (lambda: centroids.update_centroids(c, add, none, "y"), lambda: centroids.update_centroids(c, add.withColumn("cluster_id", F.lit("zz")), none, "x"), lambda: centroids.update_centroids(c, add, c, "x")):
        with pytest.raises(Exception, match="embedder|unknown cluster|already"):
            bad().collect()


def base(spark):
    e = entities(spark, [("d1", "Alice", (1, 0, 0)), ("d2", "Alice", (1, 0, 0)), ("d3", "Bob", (0, 1, 0))])
    tagged = cluster.apply_assignments(e, cluster.resolve(e).assignments)
    return cluster.registry(tagged), centroids.compute_centroids(tagged, "x")


def test_incremental(spark):
    reg, cen = base(spark)
    new = entities(spark, [("n1", "Alice B", (1, 0, 0)), ("n2", "Cara", (0, 0, 1)), ("n3", "Cara", (0, 0, 1))])
    r = resolve_incremental(new, reg, cen, "x")
    a = {x.entity_id: x for x in r.assignments.collect()}
    assert a["e1"].cluster_id == a["e2"].cluster_id and a["e1"].source == "singleton" and a["e2"].source == "threshold"
    size = {x.cluster_id: x.size for x in r.centroids.collect()}
    assert size[a["e0"].cluster_id] == 3 and size[a["e1"].cluster_id] == 2 and len(size) == 3
    got = {x.cluster_id: x for x in r.registry.collect()}
    assert got[a["e0"].cluster_id].canonical == "Alice B" and got[a["e0"].cluster_id].members[-1] == "n1/e0" and len(got[a["e0"].cluster_id].members) == 3
    with pytest.raises(ValueError, match="embedder"):
        resolve_incremental(new, reg, cen, "other")


def test_incremental_from_nothing_and_with_nothing(spark):
    reg, cen = base(spark)
    new = entities(spark, [("n1", "Alice", (1, 0, 0))])
    assert resolve_incremental(new, reg.limit(0), cen.limit(0), "x").centroids.count() == 1
    assert resolve_incremental(new.limit(0), reg, cen, "x").registry.count() == reg.count()


def e_(doc, name, *v):
    return {"doc_id": doc, "entity_id": name, "canonical": name, "surface_canonical": name, "vector": unit(*v)}


def test_fold_order_and_frozen_centroids():
    old = [{"cluster_id": "c", "canonical": "C", "centroid": unit(1, 0, 0)}]
    new = [e_("1", "a", 0.9, 0.44, 0), e_("2", "b", 0.6, 0.8, 0)]
    out = fold("T", new, old, None, 0.82, 0.75)
    assert out[0]["cluster_id"] == "c" and out[1]["source"] == "singleton"  # the old centroid didn't move towards b


def test_fold_keeps_a_provisional_cluster_that_others_joined():
    old = [{"cluster_id": "c", "canonical": "C", "centroid": unit(1, 0)}]
    new = [e_("1", "a", 0.78, 0.6258), e_("2", "b", 0.6, 0.8)]
    out = fold("T", new, old, NearestTieBreaker(), 0.82, 0.75)
    assert out[0]["cluster_id"] == "c" and out[0]["source"] == "llm_tiebreak"
    assert out[1]["is_new"] and out[1]["size"] == 1 and out[1]["centroid"] == pytest.approx(unit(0.6, 0.8))


def test_assignments_are_those_of_a_fold_with_all_clusters_at_hand(spark, monkeypatch):
    from entloom.operators import similarity
    from entloom.operators.incremental import assign

    monkeypatch.setattr(similarity, "BLOCK", 5)
    r = np.random.default_rng(3)
    old = [{"cluster_id": f"c_{k:010x}", "canonical": f"n{k}", "type": "T", "centroid": unit(*r.normal(size=4))} for k in range(23)]
    new = [e_(f"d{k:02}", f"x{k % 7}", *r.normal(size=4)) for k in range(40)]
    old.append({"cluster_id": new_cluster_id("T", "x3", "d03", set()), "canonical": "x3", "type": "T", "centroid": unit(-1, 0, 0, 0)})  # d03 can't have its own id
    old.sort(key=lambda c: c["cluster_id"])
    want = {x["doc_id"]: x for x in fold("T", new, old, NearestTieBreaker(0.85), 0.9, 0.8)}
    registry = spark.createDataFrame([(c["cluster_id"], c["canonical"], c["type"], ["a/b"]) for c in old], "cluster_id string, canonical string, type string, members array<string>")
    cen = spark.createDataFrame([(c["cluster_id"], c["type"], c["centroid"], 1, "x") for c in old], "cluster_id string, type string, centroid array<double>, size int, embedder_id string")
    rows = spark.createDataFrame([(e["doc_id"], e["entity_id"], "T", e["canonical"], e["canonical"], e["vector"]) for e in new], "doc_id string, entity_id string, type string, canonical string, surface_canonical string, vector array<double>")
    got = {x.doc_id: x for x in assign(rows, cen, registry, NearestTieBreaker(0.85), 0.9, 0.8).collect()}
    assert len(got) == 40 and {x.source for x in got.values()} == {"threshold", "singleton", "llm_tiebreak"}
    for d, x in got.items():
        assert (x.cluster_id, x.source, x.is_new) == (want[d]["cluster_id"], want[d]["source"], want[d]["is_new"])
        assert (x.top_similarity, x.second_similarity) == pytest.approx((want[d]["top_similarity"], want[d]["second_similarity"]))


def test_new_ids_avoid_taken_ones():
    a = new_cluster_id("T", "x", "d", set())
    assert new_cluster_id("T", "x", "d", {a}) == a + "_1" and new_cluster_id("T", "x", "d", {a, a + "_1"}) == a + "_2"


def test_embedders():
    for e in (HashedEmbedder(), FirstLetterEmbedder()):
        v = e.encode(["Alice", "alice", "Bob", ""])
        assert v.dtype == np.float32 and np.allclose(np.linalg.norm(v, axis=1), 1) and np.allclose(v[0], v[1])
        assert e.encode([]).shape == (0, 0)


def prf(spark, system, gold):
    s = spark.createDataFrame([("d", k, c) for k, c in system.items()], "doc_id string, entity_id string, cluster_id string")
    g = spark.createDataFrame([("d", k, c) for k, c in gold.items()], "doc_id string, entity_id string, gold_cluster_id string")
    t = evaluate.contingency(s, g)
    return tuple(evaluate.pairwise_prf(t).first()), tuple(evaluate.bcubed_prf(t).first())


@pytest.mark.parametrize(
    ("system", "gold", "pair", "cubed"),
    [
        ("aab", "xxy", (1, 1, 1), (1, 1, 1)), ("abc", "xxx", (1, 0, 0), (1, 1 / 3, 0.5)), ("aab", "xxx", (1, 1 / 3, 0.5), (1, 5 / 9, 5 / 7)),
        ("aaa", "xyz", (0, 1, 0), (1 / 3, 1, 0.5)), ("a", "x", (1, 1, 1), (1, 1, 1)), ("", "", (0, 0, 0), (0, 0, 0)),
    ],
)
def test_prf(spark, system, gold, pair, cubed):
    p, b = prf(spark, {str(k): c for k, c in enumerate(system)}, {str(k): c for k, c in enumerate(gold)})
    assert p == pytest.approx(pair) and b == pytest.approx(cubed)


def test_prf_ignores_what_gold_lacks(spark):
    p, _ = prf(spark, {"1": "a", "2": "a", "zz": "a"}, {"1": "x", "2": "x"})
    assert p == (1, 1, 1)


def test_sweep(spark):
    rng = np.random.default_rng(1)
    e = entities(spark, [(f"d{k}", f"n{k}", unit(*(np.eye(3)[k % 3] + rng.normal(size=3) * 0.3))) for k in range(15)])
    gold = e.select("doc_id", "entity_id", (F.col("ord") % 3).cast("string").alias("gold_cluster_id"))
    s = evaluate.sweep_thresholds(e, gold)
    assert s.count() == 8 and evaluate.best_point(s).count() == 1
    for merge in (0.78, 0.86):
        plain = cluster.apply_assignments(e, cluster.resolve(e, merge=merge, borderline=0.7).assignments)
        one = evaluate.evaluate(plain.select("doc_id", "entity_id", "cluster_id"), gold).first()
        assert s.filter(F.abs(F.col("merge_threshold") - merge) < 1e-9).first().pairwise_f1 == pytest.approx(one.pairwise_f1)
