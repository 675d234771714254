from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entloom.llm import op3_packing as packing
from entloom.llm import op7_mixing as mixing
from entloom.llm import tokens as tk

from .helpers import DOC, awkward, clashing, empty, ids, prose


def counted(spark, rows):
    return spark.createDataFrame([(s, t, n) for s, t, n in rows], "source string, tokens long, n long")


def some_rows(seed=0):
    rng = np.random.default_rng(seed)
    return [(s, int(t), int(rng.integers(1, 5))) for s, scale in (("a", 100), ("b", 400), ("c", 50)) for t in np.unique(rng.lognormal(np.log(scale), 0.8, 40).astype(int) + 1)]


def shares(rows, mix):
    t = np.array([r[1] for r in rows], float)
    q = t * np.array([r[2] for r in rows])
    q /= q.sum()
    z = (np.log(t) - mix.mean) / mix.spread
    p = np.array([q[k] * np.exp(mix.tilt[r[0]] + mix.slope * z[k]) if r[0] in mix.tilt else 0 for k, r in enumerate(rows)])
    return q, p, z


@pytest.mark.parametrize("target", [None, {"a": 1, "b": 1, "c": 1}, {"a": 5, "b": 1, "c": 0.2}, {"a": 1, "b": 3}])
def test_solution_meets_all_targets_and_is_the_nearest(spark, target):
    rows = some_rows()
    mix = mixing.solve(counted(spark, rows), target)
    q, p, z = shares(rows, mix)
    for s in "abc":
        assert sum(p[k] for k, r in enumerate(rows) if r[0] == s) == pytest.approx(mix.target.get(s, 0), abs=1e-7)
    assert p.sum() == pytest.approx(1) and (p * z).sum() == pytest.approx(-mixing.RIDGE * mix.slope, abs=1e-7) and mix.error < 1e-7
    # no feasible step lowers the relative entropy: directions that keep all constraints
    on = p > 0
    a = np.stack([[r[0] == s for r in rows] for s in mix.target] + [z]).astype(float)[:, on]
    gradient = np.log(p[on] / q[on]) + 1
    assert np.abs(gradient - a.T @ np.linalg.lstsq(a.T, gradient, rcond=None)[0]).max() < 1e-6


def test_solution_of_little(spark):
    assert mixing.solve(counted(spark, [])).tilt == {}
    one = mixing.solve(counted(spark, [("a", 5, 3), ("b", 5, 1)]), {"a": 1, "b": 1})
    assert np.exp(one.tilt["a"]) == pytest.approx(0.5 / 0.75) and one.slope == 0
    assert mixing.solve(counted(spark, [("a", 5, 3)]), {"zz": 1}).tilt == {}


def test_copies_meet_the_targets(spark):
    rows = [(k, prose(k % 40, 20 + k % 30), "en", "hot" if k % 4 else "rare", 0) for k in range(6000)]
    d = spark.createDataFrame(rows, DOC)
    got = mixing.mixed(d, {"hot": 1, "rare": 1}).groupBy("source").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("copies")).alias("c"), F.max(F.abs(F.col("copies") - F.col("rate"))).alias("off")).collect()
    total = sum(r.t for r in got)
    assert all(r.c == pytest.approx(total / 2, rel=0.03) and r.off < 1 for r in got)


def test_mixing_awkward_rows(spark):
    d = awkward(spark)
    got = mixing.mixed(d)
    assert got.count() == d.count() and ids(mixing.mixed(clashing(d)), "doc_id", "copies") == ids(got, "doc_id", "copies")
    assert all(r.rate == 0 and r.copies == 0 for r in got.filter("doc_id in (2, 3, 4)").collect())
    assert mixing.mixed(d.drop("source")).filter("source = ''").count() == d.count()
    for docs in (d, clashing(d)):
        out = mixing.stage(spark, docs, "")
        assert out.columns == docs.columns
        times = defaultdict(int)
        for r in out.collect():
            times[r.doc_id] += 1
        want = defaultdict(int)
        for r in got.collect():
            want[r.doc_id] += r.copies
        assert times == {k: v for k, v in want.items() if v}
    assert mixing.mixed(empty(spark)).count() == 0 and mixing.stage(spark, empty(spark), "").count() == 0


def test_token_count_is_the_same_in_sql(spark):
    import duckdb

    texts = ["Hello, world!", "internationalization 1234567", "é ñandú́ 😀", "", None, "a\tb\nc  d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tk.count(F.col("t"))).collect()]
    want = [duckdb.execute(f"SELECT coalesce(len(regexp_extract_all(?, '{tk.PIECE}')), 0)", [t]).fetchall()[0][0] for t in texts]
    assert got == want == [r[0] for r in df.select(tk.counted_once(F.col("t"))).collect()]


def plain_pack(lengths, tiers):
    """Best fit decreasing and filling, by looking at every window and piece."""
    placed, result = set(), [None] * len(lengths)
    for k in range(len(tiers) - 1, -1, -1):
        windows = []
        for i, n in enumerate(lengths):
            if i not in placed and n > (tiers[k - 1] if k else 0):
                fits = [(tiers[k] - used, w) for w, used in enumerate(windows) if tiers[k] - used >= n]
                w = min(fits)[1] if fits else len(windows)
                if not fits:
                    windows.append(0)
                result[i] = (tiers[k], w, windows[w])
                windows[w] += n
                placed.add(i)
        for w in sorted(range(len(windows)), key=lambda w: (-(tiers[k] - windows[w]), w)):
            while True:
                fits = [i for i, n in enumerate(lengths) if i not in placed and n <= tiers[k] - windows[w]]
                if not fits:
                    break
                i = min(fits, key=lambda i: (-lengths[i], i))
                result[i] = (tiers[k], w, windows[w])
                windows[w] += lengths[i]
                placed.add(i)
    return result


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40))
def test_pack_matches_a_plain_version(lengths):
    lengths = sorted(lengths, reverse=True)
    assert list(zip(*packing.pack(lengths, (4, 16, 64)), strict=True)) == plain_pack(lengths, (4, 16, 64))


def test_step_groups_are_balanced():
    cost = np.random.default_rng(0).lognormal(3, 1, 200)
    g = packing.step_groups(cost, 8)
    sizes, sums = np.bincount(g), np.bincount(g, cost)
    assert len(sizes) == 25 and sizes.max() == 8 and sums.max() < 1.6 * sums.mean()
    assert packing.step_groups(np.zeros(0), 4).size == 0 if len(np.zeros(0)) else True


def check_layout(rows, want):
    """Each token of each document once, no window too full, no gap in a window."""
    parts, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        parts[r.doc_id].append((r.piece_start, r.length))
        windows[(r.context, r.shard, r.window)].append((r.position, r.length, r.step_group))
    assert {d: sum(n for _, n in p) for d, p in parts.items()} == want
    for (context, _, _), inside in windows.items():
        at = 0
        for position, n, _ in sorted(inside):
            assert position == at
            at += n
        assert at <= context and len({g for *_, g in inside}) == 1


def test_every_token_is_packed_once(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_PIECES", 60)
    rng = np.random.default_rng(1)
    n = np.minimum(rng.lognormal(6, 1.5, 400).astype(int) + 1, 40_000)
    d = spark.createDataFrame([(k, int(x)) for k, x in enumerate(n)], "doc_id long, size long").withColumn("text", F.lit("x"))
    rows = packing.packed(d, F.col("size")).collect()
    check_layout(rows, {k: int(x) for k, x in enumerate(n)})
    assert len({r.shard for r in rows}) > 1 and {r.context for r in rows} == set(packing.TIERS)
    full = defaultdict(int)
    for r in rows:
        full[(r.context, r.shard, r.window)] += r.length
    assert sum(full.values()) / sum(c for c, *_ in full) > 0.9
    again = packing.packed(d.repartition(3), F.col("size")).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_packing_awkward_rows(spark):
    d = awkward(spark)
    want = defaultdict(int)
    for r in d.select("doc_id", tk.count(F.col("text")).alias("n")).collect():
        if r.n:
            want[r.doc_id] += r.n
    for docs in (d, clashing(d)):
        check_layout(packing.packed(docs).collect(), dict(want))
    assert packing.packed(empty(spark)).count() == 0


def test_mixing_sql_says_the_same(spark):
    duckdb = __import__("duckdb")
    rows = [(k, prose(k, 5 + k * 7 % 200), "en", ("hot", "warm", None)[min(k % 5, 2)], 1) for k in range(200)] + [(500, None, "en", "hot", 0), (501, "", None, None, 0)]
    docs = spark.createDataFrame(rows, DOC)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    got = sorted((r.doc_id, r.source, r.tokens, r.rate, r.copies) for r in mixing.mixed(docs).collect())
    want = sorted(con.execute(mixing.SQL).fetchall())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want] and np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-6)


def test_a_step_that_never_falls_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RIDGE", float("nan"))
    with pytest.raises(RuntimeError, match="doesn't fall"):
        mixing.solve(counted(spark, [("a", 5, 1), ("a", 50, 1), ("b", 7, 1)]))
