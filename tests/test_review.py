import pytest
from pyspark.sql import functions as F

from entloom import EntitySchema, EntityType
from entloom.model import ENTITY, REVIEW_LINE, review_json_schema
from entloom.operators import review
from entloom.sources.workdir import load_gold, read_review, save_gold, write_review

TEXT = "Marie Curie discovered radium. Curie also won a Nobel Prize."
SCHEMA = EntitySchema((EntityType("Person", "human"), EntityType("Thing", "thing")))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([("d1", TEXT), ("d2", "Bob.")], "doc_id string, text string")


@pytest.fixture
def rows(spark):
    def m(i, s, e, t, kind):
        return (i, s, e, t, kind, 0.9, "gliner", None)

    data = [("d1", "e_1", "Person", "Marie Curie", "Marie Curie", 0.9, "c1", [m("m1", 0, 11, "Marie Curie", "Person"), m("m2", 31, 36, "Curie", "Person")]), ("d1", "e_2", "Thing", "radium", "radium", 0.4, None, [m("m3", 23, 29, "radium", "Thing")]), ("d2", "e_3", "Person", "Bob", "Bob", 0.9, None, [m("m4", 0, 3, "Bob", "Person")])]
    return spark.createDataFrame(data, ENTITY)


def lines(rows):
    return review.review_lines(rows)


def apply(rows, ls, docs):
    return {r.entity_id: r for r in review.apply_review(rows, ls, docs).collect()}


def test_lines_and_files_round_trip(spark, rows, docs, tmp_path):
    flags = rows.filter("confidence < 0.7").select("doc_id", "entity_id", F.lit("low_cluster_conf").alias("reason"))
    ls = review.review_lines(rows, flags)
    assert [(r.doc_id, r.line, r.id, r.reason) for r in ls.orderBy("doc_id", "line").collect()] == [("d1", 2, "e_1", None), ("d1", 3, "e_2", "low_cluster_conf"), ("d2", 2, "e_3", None)]
    write_review(review.to_jsonl(ls, review.header(docs, "1")), str(tmp_path / "r"))
    assert sorted(p.name for p in (tmp_path / "r").iterdir()) == ["d1.jsonl", "d2.jsonl"]
    assert '"cluster_id"' not in (tmp_path / "r/d2.jsonl").read_text()
    headers, back = read_review(spark, str(tmp_path / "r"))
    assert headers.count() == 2 and back.count() == 3
    assert review.lint(back, headers, docs, SCHEMA, rows).count() == 0
    same = apply(rows, back, docs)
    assert {k: (r.canonical, r.cluster_id, len(r.mentions)) for k, r in same.items()} == {"e_1": ("Marie Curie", "c1", 2), "e_2": ("radium", None, 1), "e_3": ("Bob", None, 1)}
    assert [r.id for r in review.review_lines(rows, flags, only_flagged=True).collect()] == ["e_2"]


def test_ops(rows, docs):
    ls = lines(rows)
    assert set(apply(rows, ls.filter("id = 'e_1'").withColumn("op", F.lit("reject")), docs)) == {"e_2", "e_3"}
    assert set(apply(rows, ls.filter("id = 'e_1'").withColumn("op", F.lit("reject")).withColumn("id", F.lit("zz")), docs)) == {"e_1", "e_2", "e_3"}
    edited = apply(rows, ls.filter("id = 'e_2'").withColumn("op", F.lit("edit")).withColumn("type", F.lit("Person")).withColumn("canonical", F.lit("Ra")), docs)
    assert edited["e_2"].canonical == "Ra" and edited["e_2"].mentions[0].type == "Person"
    added = apply(rows, ls.filter("id = 'e_2'").withColumn("op", F.lit("add")).withColumn("id", F.lit("human_1")), docs)
    assert len(added) == 4


def test_missing_mention_ids_are_made(rows, docs):
    ls = lines(rows).filter("id = 'e_2'").withColumn("mentions", F.transform("mentions", lambda m: m.withField("id", F.lit(None).cast("string")).withField("source", F.lit("human"))))
    assert apply(rows, ls, docs)["e_2"].mentions[0].id.startswith("human_")


@pytest.mark.parametrize(("change", "told"), [({"op": "edit", "id": "zz"}, "unknown entity"), ({"op": "add", "id": "x"}, "human_"), ({"op": "what"}, "unknown op")])
def test_bad_ops(rows, docs, change, told):
    ls = lines(rows).filter("id = 'e_2'")
    for k, v in change.items():
        ls = ls.withColumn(k, F.lit(v))
    with pytest.raises(Exception, match=told):
        apply(rows, ls, docs)


def test_span_must_fit(rows, docs):
    ls = lines(rows).filter("id = 'e_2'").withColumn("mentions", F.transform("mentions", lambda m: m.withField("text", F.lit("gold!!"))))
    with pytest.raises(Exception, match="span differs"):
        apply(rows, ls, docs)


def messages(*args):
    return sorted((r.doc_id, r.line, r.message) for r in review.lint(*args).collect())


def test_lint(rows, docs):
    ls, h = lines(rows), review.header(docs, "1")
    assert messages(ls, h, docs, SCHEMA, rows) == []
    assert messages(ls.withColumn("type", F.lit("Nope")).filter("id = 'e_2'"), None, None, SCHEMA) == [("d1", 3, "unknown type: Nope")]
    assert messages(ls, h.withColumn("text_sha", F.lit("0")), docs)[0][1:] == (1, "the document's text has changed")
    assert ("d1", 1, "schema version is 9") in messages(ls, h.withColumn("schema_version", F.lit("9")), docs, SCHEMA)
    assert ("d1", 1, "unknown format: x") in messages(ls, h.withColumn("format", F.lit("x")))
    wrong = ls.filter("id = 'e_2'").withColumn("mentions", F.transform("mentions", lambda m: m.withField("text", F.lit("radiun"))))
    assert messages(wrong, None, docs) == [("d1", 3, "text differs at 23-29")]
    far = ls.filter("id = 'e_2'").withColumn("mentions", F.transform("mentions", lambda m: m.withField("end", F.lit(999))))
    assert messages(far, None, docs) == [("d1", 3, "span out of bounds: 23-999")]
    twice = ls.filter("id = 'e_2'").withColumn("mentions", F.concat("mentions", "mentions"))
    assert messages(twice) == [("d1", 3, "mentions overlap")]
    assert messages(ls.unionByName(ls.filter("id = 'e_2'").withColumn("line", F.lit(9)))) == [("d1", 3, "id repeats: e_2"), ("d1", 9, "id repeats: e_2")]
    assert messages(ls.withColumn("doc_id", F.lit("gone")).filter("id = 'e_2'"), None, docs)[0][2] == "no such document"


def test_reading_is_strict(spark, tmp_path):
    head = '{"$schema": "entloom/review/v1", "doc_id": "d", "text_sha": "0", "schema_version": "1"}\n'
    for body, told in ((head + '{"id": "e", "colour": 1}\n', "bad review line"), ('{"id": "e"}\n', "no review header")):
        (tmp_path / "x.jsonl").write_text(body)
        with pytest.raises(Exception, match=told):
            read_review(spark, str(tmp_path))[1].collect()
    (tmp_path / "x.jsonl").write_text("\n")
    with pytest.raises(ValueError, match="empty"):
        read_review(spark, str(tmp_path))
    (tmp_path / "x.jsonl").write_text(head + "\n" + '{"id": "e", "type": "T", "mentions": []}\n')
    _, ls = read_review(spark, str(tmp_path / "x.jsonl"))
    assert [(r.doc_id, r.line, r.op) for r in ls.collect()] == [("d", 2, "keep")] and set(REVIEW_LINE.fieldNames()) <= set(ls.columns)


def test_json_schema_names_the_fields_of_a_line():
    header, line = review_json_schema()["oneOf"]
    assert set(line["properties"]) == set(REVIEW_LINE.fieldNames()) and set(header["required"]) == set(header["properties"])


def test_gold(spark, tmp_path):
    rows = [("d1", "e1", "g"), ("d1", "e2", "g"), ("d2", "e1", "h")]
    save_gold(spark.createDataFrame(rows, "doc_id string, entity_id string, gold_cluster_id string"), str(tmp_path / "gold"))
    assert sorted(map(tuple, load_gold(spark, str(tmp_path / "gold")).collect())) == rows
    one = '{"doc_id": "d", "entity_id": "e", "gold_cluster_id": "g"}\n'
    (tmp_path / "g.jsonl").write_text("# note\n\n" + one)
    assert load_gold(spark, str(tmp_path / "g.jsonl")).count() == 1
    (tmp_path / "g.jsonl").write_text(one + one)
    with pytest.raises(ValueError, match="twice"):
        load_gold(spark, str(tmp_path / "g.jsonl"))
    (tmp_path / "g.jsonl").write_text('{"doc_id": "d"}\n')
    with pytest.raises(Exception, match="lacks"):
        load_gold(spark, str(tmp_path / "g.jsonl")).collect()
