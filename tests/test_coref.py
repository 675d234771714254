import pytest
from pyspark.sql import functions as F

from entloom import EntitySchema, EntityType
from entloom.backends import BackendError, FirstWordCoref, Group, Merge, SameSurfaceCoref, ToolClient, checked_groups, checked_merges
from entloom.functions import scores
from entloom.operators import coref

SCHEMA = EntitySchema((EntityType("Person", "human"), EntityType("Org", "group")))
MENTION = "doc_id string, id string, start int, end int, text string, type string, score double, source string"
CURIE = [("d", "m1", 0, 11, "Marie Curie", "Person", 0.95, "gliner"), ("d", "m2", 20, 25, "Curie", "Person", 0.82, "gliner")]


def entities(spark, groups, mentions):
    g = spark.createDataFrame(groups, "doc_id string, canonical string, type string, confidence double, mention_ids array<string>")
    return coref.entities(g, spark.createDataFrame(mentions, MENTION))


def test_entity_of_two_mentions(spark):
    r = entities(spark, [("d", "Marie Skłodowska Curie", "Person", 0.9, ["m2", "m1"])], CURIE).first()
    assert r.surface_canonical == "Marie Curie" and r.canonical == "Marie Skłodowska Curie"
    assert r.confidence == pytest.approx(0.8925) and [m.id for m in r.mentions] == ["m1", "m2"]
    assert r.entity_id.startswith("e_") and r.cluster_id is None


def test_first_longest_surface(spark):
    ms = [("d", "a", 5, 8, "Bob", "Person", 0.9, "x"), ("d", "b", 0, 3, "Rob", "Person", 0.9, "x")]
    assert entities(spark, [("d", "c", "Person", 0.9, ["a", "b"])], ms).first().surface_canonical == "Rob"


def test_same_surface_and_client_agree(spark):
    ms = [*CURIE, ("d", "m3", 40, 45, "CURIE", "Person", 0.5, "gliner"), ("d", "m4", 50, 55, "Curie", "Org", 0.5, "gliner"), ("e", "m5", 0, 5, "Curie", "Person", 0.7, "gliner")]
    m = spark.createDataFrame(ms, MENTION)
    docs = spark.createDataFrame([("d", "x"), ("e", "y"), ("f", "no mentions")], "doc_id string, text string")
    key = lambda df: sorted((r.doc_id, r.type, tuple(sorted(r.mention_ids))) for r in df.collect())
    a, b = coref.same_surface_groups(m), coref.client_groups(m, docs, SCHEMA, SameSurfaceCoref())
    assert key(a) == key(b) == [("d", "Org", ("m4",)), ("d", "Person", ("m1",)), ("d", "Person", ("m2", "m3")), ("e", "Person", ("m5",))]
    assert coref.partition_violations(a, m, SCHEMA).count() == 0
    first = coref.client_groups(m, docs, SCHEMA, FirstWordCoref())
    assert ("d", "Person", ("m1",)) in key(first)


def test_client_takes_documents_in_batches(spark):
    """Once each document was a group of data frames of its own; texts may be missing, null or there twice."""
    m = spark.createDataFrame([(d, f"{d}{k}", 9 - k, 10 - k, "x", "Person", 0.5, "s") for d in "abcd" for k in range(3)], MENTION)
    docs = spark.createDataFrame([("a", "one"), ("b", None), ("c", "two"), ("c", "two")], "doc_id string, text string")

    class Told:
        def group(self, doc_id, text, mentions, schema):
            assert [m["start"] for m in mentions] == [7, 8, 9] and mentions[0]["doc_id"] == doc_id
            return [Group(tuple(m["id"] for m in mentions), text, "Person", 0.5)]

    found = coref.client_groups(m, docs, SCHEMA, Told())
    assert sorted((r.doc_id, r.canonical, list(r.mention_ids)) for r in found.collect()) == [("a", "one", ["a2", "a1", "a0"]), ("b", "", ["b2", "b1", "b0"]), ("c", "two", ["c2", "c1", "c0"]), ("d", "", ["d2", "d1", "d0"])]
    plan = found._jdf.queryExecution().toString()
    assert "CoGroups" not in plan and "MapInArrow" in plan


def test_partition_violations(spark):
    m = spark.createDataFrame(CURIE, MENTION)
    g = spark.createDataFrame([("d", "x", "Person", 0.9, ["m1", "zz"]), ("d", "y", "Nope", 0.9, ["m1"])], "doc_id string, canonical string, type string, confidence double, mention_ids array<string>")
    got = {(r.id, r.problem) for r in coref.partition_violations(g, m, SCHEMA).collect()}
    assert got == {("m1", "repeated"), ("zz", "unknown"), ("m2", "missing"), ("Nope", "type")}


@pytest.mark.parametrize(("groups", "told"), [([Group(("m1", "x"), "c", "Person", 0.9)], "unknown mentions"), ([Group(("m1", "m2"), "c", "Nope", 0.9)], "unknown type"), ([Group(("m1", "m2"), "c", "Person", 0.9), Group(("m2",), "d", "Person", 0.9)], "two places"), ([Group(("m1",), "c", "Person", 0.9)], "no group"), ([Group(("m1", "m1", "m2"), "c", "Person", 0.9)], "two places")])
def test_groups_must_partition(groups, told):
    with pytest.raises(BackendError, match=told):
        checked_groups(groups, [{"id": "m1"}, {"id": "m2"}], SCHEMA)


def test_merges_must_answer_all():
    ok = [Merge("a", "c1", 0.9), Merge("b", None, 0.5)]
    assert checked_merges(ok, ["a", "b"], {"c1": "x"}) == ok
    for bad, told in (([Merge("a", "c9", 0.9), ok[1]], "unknown clusters"), ([ok[0]], "no decision"), ([*ok, Merge("z", None, 1)], "unknown entities")):
        with pytest.raises(BackendError, match=told):
            checked_merges(bad, ["a", "b"], {"c1": "x"})


def test_tool_client_retries_and_counts():
    one = dict(type="Person", confidence=0.8, canonical="X", mention_ids=["m1"])
    answers = [RuntimeError("busy"), ('{"clusters": []}', {}), (dict(clusters=[one]), {"input_tokens": 40, "cache_read_tokens": 60})]

    def send(system, block, prompt, tool):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    c = ToolClient(send)
    assert c.cache_hit_ratio is None and c.group("d", "t", [], SCHEMA) == []
    m = [{"id": "m1", "start": 0, "end": 1, "text": "X", "type": "Person", "score": 0.12345}]
    assert c.group("d", "X", m, SCHEMA)[0].canonical == "X" and c.cache_hit_ratio == 0.6
    with pytest.raises(BackendError, match="3 times"):
        ToolClient(lambda *a: ("not json", {})).group("d", "X", m, SCHEMA)


def test_confidence_and_routing(spark):
    row = spark.range(1)
    one = lambda c: row.select(c).first()[0]
    assert one(scores.within_doc_confidence(F.lit(0.5), F.lit(0.8))) == pytest.approx(0.65)
    assert one(scores.within_doc_confidence(F.lit(1.0), F.lit(7.0))) == 1.0
    assert one(scores.crossdoc_confidence(F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0))) == pytest.approx(0.8)
    assert one(scores.crossdoc_confidence(F.lit(1.0), F.lit(1.0), F.lit(0.4), F.lit(0.7))) == pytest.approx(0.8)
    cases = [(0.5, None, 0.9, "low_cluster_conf"), (0.5, "c", 0.9, "ambiguous_merge"), (0.9, None, 0.3, "low_span_conf"), (0.9, "c", 0.9, None), (0.7, None, 0.5, None)]
    df = spark.createDataFrame([c[:3] for c in cases], "a double, b string, c double")
    assert [r[0] for r in df.select(scores.review_reason(F.col("a"), F.col("b"), F.col("c"))).collect()] == [c[3] for c in cases]
