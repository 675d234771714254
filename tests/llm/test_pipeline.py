import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from entloom.llm import op1_secrets, op3_packing, op5_language, op6_neardup, op7_mixing, registry
from entloom.llm import tokens as tk

from .helpers import DOC, awkward, clashing
from .test_language import say
from .test_mix_pack import check_layout
from .test_neardup import brute_groups, edited
from .test_secrets import SECRETS


def corpus(spark):
    rows = [(k, say(("en", "de", "fr")[k % 3], k, 70 + k % 50), ("en", "de", "fr")[k % 3], "hot" if k % 4 else "rare", 0) for k in range(120)]
    rows += [(200 + k, edited(rows[k][1], 0.03, k), rows[k][2], "rare", 0) for k in range(12)] + [(300 + k, rows[k][1], rows[k][2], "hot", 0) for k in range(5)]
    rows += [(400, "0123 4567 !!", "en", "hot", 0), (401, say("en", 401) + " " + SECRETS["assigned_secret"], "en", "hot", 0), (402, None, "en", "hot", 0)]
    return rows, spark.createDataFrame(rows, DOC)


def test_stages_against_a_plain_version(spark, tmp_path):
    rows, docs = corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "secret_scan", "mixing", "packing"]
    out, seen = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        seen[name] = out
        assert k == 4 or out.columns == docs.columns
    text = {r[0]: r[1] for r in rows}
    spoken = {r.doc_id for r in seen["language_id"].collect()}
    assert spoken == {d for d in text if d not in (400, 402)}
    ordered = sorted((d, text[d]) for d in spoken)
    _, root = brute_groups(ordered)
    kept = {ordered[k][0] for k, r in enumerate(root) if r == k}
    assert {r.doc_id for r in seen["near_dedup"].collect()} == kept and not kept & set(range(200, 400))
    scanned = {r.doc_id: r.text for r in seen["secret_scan"].collect()}
    assert set(scanned) == kept and "[ASSIGNED_SECRET]" in scanned[401] and all(scanned[d] == text[d] for d in kept if d != 401)
    rates = {r.doc_id: r for r in op7_mixing.mixed(seen["secret_scan"]).collect()}
    assert {r.doc_id: r["count"] for r in seen["mixing"].groupBy("doc_id").count().collect()} == {d: r.copies for d, r in rates.items() if r.copies}
    want = {r.doc_id: r.n for r in seen["mixing"].groupBy("doc_id").agg(F.sum(tk.count(F.col("text"))).alias("n")).collect()}
    check_layout(seen["packing"].collect(), want)
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, seen["packing"].collect()))


def test_awkward_rows_and_none(spark, tmp_path):
    for name, docs in (("awkward", clashing(awkward(spark))), ("none", awkward(spark).limit(0))):
        folder = tmp_path / name
        docs.write.parquet(str(folder / "documents.parquet"))
        out = corpus_pipeline.run(spark, str(folder))
        assert out.columns == op3_packing.packed(awkward(spark)).columns and (out.count() > 0) == (name == "awkward")


def test_stages_call_the_operators():
    assert [f for _, f in corpus_pipeline.STAGES] == [op5_language.stage, op6_neardup.stage, op1_secrets.stage, op7_mixing.stage, op3_packing.stage]


def test_registry():
    numbers = sorted(int(k[2:].split("_")[0]) for k in registry.QUERIES)
    assert numbers == list(range(1, 11)) and set(registry.ORACLE_SQL) <= set(registry.QUERIES)


def test_no_session_is_needed_to_import():
    root = Path(__file__).resolve().parents[2]
    found = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=root, capture_output=True, text=True, timeout=120, check=False)
    assert found.returncode == 0, found.stderr


def test_shared_folder_is_read_from_the_session(spark):
    from entloom.llm.store import shared_dir

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")

    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Cluster)
