import hashlib
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from entloom import EntitySchema, EntityType
from entloom.backends import KeywordExtractor
from entloom.functions import ids, text
from entloom.operators import extract

MENTION = "doc_id string, id string, start int, end int, text string, type string, score double, source string"


def tokens(spark, *texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = extract.token_offsets(docs).orderBy("doc_id", "start").collect()
    return [[(r.start, r.end, r.token) for r in rows if r.doc_id == str(k)] for k in range(len(texts))]


def reference_tokens(s):
    return [(m.start(), m.end(), m.group()) for m in re.finditer(r"\w(?:['’\-\w]*\w)?|\S", s)]


def test_tokens(spark):
    texts = ["Marie Curie's well-known work — on radium, in Paris.", "L’été à Zürich", "", "a", "x\t\ny", "😀 smile ² ½"]
    assert tokens(spark, *texts) == [reference_tokens(s) for s in texts]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab'-’é 1_.,\n\t—ñ", max_size=30), min_size=40, max_size=40))
def test_tokens_property(spark, texts):
    assert tokens(spark, *texts) == [reference_tokens(s) for s in texts]


def test_token_count_agrees(spark):
    body = "It's a well-known fact; isn't it?"
    n = spark.createDataFrame([(body,)], "t string").select(text.token_count(F.col("t"))).first()[0]
    assert n == len(reference_tokens(body))


@pytest.mark.parametrize(("body", "start", "end", "want"), [("Marie Curie was a physicist.", 2, 11, (0, 11)), ("Marie Curie was a physicist.", 0, 9, (0, 11)), ("abcd efgh ijkl", 1, 7, (0, 9)), ("abcd efgh", 0, 5, (0, 4)), ("abcd efgh", 4, 9, (5, 9)), ("abcd", 3, 9, (3, 9)), ("abcd", 2, 2, (2, 2))])
def test_snap(spark, body, start, end, want):
    docs = spark.createDataFrame([("d", body)], "doc_id string, text string")
    spans = spark.createDataFrame([("d", start, end, "T")], "doc_id string, start int, end int, type string")
    r = extract.snap(spans, docs).first()
    assert (r.start, r.end) == want
    if want[1] <= len(body):
        assert r.text == body[want[0] : want[1]]


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text(alphabet="ab'-’é 1_.\n", min_size=1, max_size=14), st.integers(0, 14), st.integers(1, 14)), min_size=30, max_size=30))
def test_snap_property(spark, cases):
    docs = spark.createDataFrame([(str(k), t) for k, (t, *_) in enumerate(cases)], "doc_id string, text string")
    spans = spark.createDataFrame([(str(k), s, s + n, "T") for k, (_, s, n) in enumerate(cases)], "doc_id string, start int, end int, type string")
    got = {int(r.doc_id): (r.start, r.end) for r in extract.snap(spans, docs).collect()}
    for k, (body, start, n) in enumerate(cases):
        end = start + n
        want = (start, end)
        if end <= len(body):
            for a, b, _ in reference_tokens(body):
                start, end = (a if a < start < b else start), (b if a < end < b else end)
            while start < end and body[start].isspace():
                start += 1
            while end > start and body[end - 1].isspace():
                end -= 1
            want = (start, end)
            if start == end:  # nothing but blanks: where in them an empty span lies is no matter
                assert got[k][0] == got[k][1]
                continue
        assert got[k] == want, (body, cases[k], got[k], want)


def nms(spark, *spans):
    rows = [("d", f"m{k}", s, e, "x" * (e - s), t, p, "gliner") for k, (s, e, t, p) in enumerate(spans)]
    found = extract.select_spans(spark.createDataFrame(rows, MENTION)).collect()
    return sorted((r.start, r.end, r.type, r.score) for r in found)


def test_select_spans(spark):
    assert nms(spark, (0, 5, "P", 0.7), (0, 5, "P", 0.9)) == [(0, 5, "P", 0.9)]
    assert nms(spark, (0, 10, "P", 0.8), (3, 7, "P", 0.95)) == [(3, 7, "P", 0.95)]
    assert len(nms(spark, (0, 15, "Org", 0.9), (8, 15, "Loc", 0.7))) == 2
    assert len(nms(spark, (0, 5, "P", 0.5), (5, 10, "P", 0.5))) == 2
    assert nms(spark, (0, 5, "P", 0.5), (0, 9, "P", 0.5)) == [(0, 9, "P", 0.5)]
    assert nms(spark) == []


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 8), st.sampled_from("AB"), st.sampled_from([0.5, 0.7, 0.9])), max_size=25))
def test_select_spans_property(spark, spans):
    spans = [(s, s + n, t, p) for s, n, t, p in spans]
    want = []
    for kind in "AB":
        kept = []
        for s, e, t, p in sorted((x for x in spans if x[2] == kind), key=lambda x: (-x[3], x[0], x[0] - x[1])):
            if not any(s < b and a < e for a, b, *_ in kept):
                kept.append((s, e, t, p))
        want += kept
    assert nms(spark, *spans) == sorted(want)


def test_ids(spark):
    row = spark.createDataFrame([("d", 3, 9, "gliner", ["b", "a"], ["y", "x", "y"])], "d string, s int, e int, src string, ms array<string>, ds array<string>")
    got = row.select(
        ids.mention_id(F.col("d"), F.col("s"), F.col("e"), F.col("src")), ids.mention_id(F.col("d"), F.col("s"), F.col("e"), F.lit("human")), ids.entity_id(F.col("d"), F.col("ms")),
        ids.cluster_id(F.lit("T"), F.lit("name"), F.col("ds")), ids.text_sha(F.lit("é")), ids.safe_filename(F.lit("a/b ü.txt")),
    ).first()

    def h(s):
        return hashlib.sha1(s.encode()).hexdigest()[:10]

    assert list(got) == ["m_" + h("d:3:9:gliner"), "human_" + h("d:3:9"), "e_" + h("d|a|b"), "c_" + h("T|name|x|y"), hashlib.sha256("é".encode()).hexdigest()[:16], "a_b_ü.txt"]


def test_rules_match_python(spark):
    texts = ["Mail a.b@mail.example.com now, or 10.0.0.1!", "Ada Lovelace Byron met Alan Turing. MIT License", "", None, "+1 (555) 123-4567 é 😀 Marie Curie"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = sorted((int(r.doc_id), r.start, r.end, r.text, r.label, r.score) for r in extract.extract_rules(docs).collect())
    want = sorted((k, m.start(), m.end(), m.group(), r.label, r.score) for k, t in enumerate(texts) for r in extract.RULES for m in re.finditer(r.pattern, t or ""))
    assert got == want


def test_backend_labels_and_checks(spark):
    schema = EntitySchema((EntityType("Person", "human"),))
    docs = spark.createDataFrame([("1", "Alice met Bob."), ("2", ""), ("3", None)], "doc_id string, text string")
    raw = extract.extract_with(docs, schema, KeywordExtractor({"Person": ["Alice", "Bob"], "Other": ["met"]}))
    assert {(r.label, r.n) for r in extract.unknown_labels(raw, schema).collect()} == {("Other", 1)}
    m = extract.mentions(extract.snap(extract.label_types(raw, schema), docs))
    assert sorted(r.text for r in m.collect()) == ["Alice", "Bob"]
    assert extract.span_violations(m, docs).count() == 0 and extract.checked(m, docs).count() == 2
    bad = m.withColumn("start", F.col("start") + 1).withColumn("end", F.col("end") + 1)
    assert extract.span_violations(bad, docs).count() == 2
    with pytest.raises(Exception, match="span differs"):
        extract.checked(bad, docs).collect()


def test_gazetteer(spark):
    docs = spark.createDataFrame([("1", "New York and York, New  York")], "doc_id string, text string")
    names = spark.createDataFrame([("Place", "New York"), ("Place", "York")], "label string, name string")
    got = sorted((r.start, r.end, r.text) for r in extract.extract_gazetteer(docs, names).collect())
    assert got == [(0, 8, "New York"), (4, 8, "York"), (13, 17, "York"), (24, 28, "York")]


def test_context(spark):
    got = spark.createDataFrame([("abc\ndef ghi",)], "t string").select(text.context(F.col("t"), F.lit(4), F.lit(7), 2), text.context(F.col("t"), F.lit(0), F.lit(3), 100)).first()
    assert list(got) == ["c def g", "abc def ghi"]


def test_offsets_of_many_matches(spark):
    body = " é ".join(f"x{k}" for k in range(1000))
    got = spark.createDataFrame([(body,), ("",), ("none",)], "t string").select(text.spans(F.col("t"), r"x[0-9]+")).collect()
    assert [(s.start, s.end, s.text) for s in got[0][0]] == [(*m.span(), m.group()) for m in re.finditer(r"x[0-9]+", body)]
    assert [r[0] for r in got[1:]] == [[], []]


def test_select_spans_of_many_stretches(spark):
    import random

    r = random.Random(4)
    rows = [("d", f"m{k:04}", s := r.randrange(3000), s + r.randrange(1, 12), "x", "AB"[k % 2], r.randrange(5) / 5, "regex") for k in range(600)]
    want = set()
    for kind in "AB":
        kept = []
        for row in sorted((x for x in rows if x[5] == kind), key=lambda x: (-x[6], x[2], -x[3], x[1])):
            if not any(row[2] < k[3] and k[2] < row[3] for k in kept):
                kept.append(row)
        want |= set(kept)
    assert {tuple(x) for x in extract.select_spans(spark.createDataFrame(rows, MENTION)).collect()} == want


def test_gazetteer_against_all_places(spark, monkeypatch):
    texts = ["Ada Lovelace's work; Ada Lovelace-King, Ada  Lovelace. The Hague? -The Hague-", "well-known Ada", "", None, "C++ and C+ +, Ada"]
    names = ["Ada", "Ada Lovelace", "The Hague", "well-known", "known", "C++", " Ada", "Ada ", "-", ""]
    want = set()
    for k, body in enumerate(texts):
        places = reference_tokens(body or "")
        for name in filter(None, names):
            for a, _, _ in places:
                if body[a : a + len(name)] == name and any(e == a + len(name) for _, e, _ in places):
                    want.add((str(k), a, a + len(name), name))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    table = spark.createDataFrame([("N", n) for n in names], "label string, name string")
    for most in (1_000_000, 2):  # the names' first tokens sent, or too many for that
        monkeypatch.setattr(extract, "SENT_NAMES", most)
        got = [(r.doc_id, r.start, r.end, r.text) for r in extract.extract_gazetteer(docs, table).collect()]
        assert set(got) == want and len(got) == len(want)
    assert extract.extract_gazetteer(docs, table.limit(0)).count() == 0


def _wide(monkeypatch):
    """Texts of 3 KB, and the most text that was taken into tokens at once."""
    import pyarrow as pa

    from entloom.functions import tokens as tk

    seen, plain = [], tk.tokenize
    monkeypatch.setattr(tk, "PIECE", 10_000)
    monkeypatch.setattr(tk, "tokenize", lambda column: seen.append(column.nbytes) or plain(column))
    texts = [None, "", "x" * 50_000, *(f"Zoë {k} well-known " * 120 for k in range(40)), None]
    return tk, pa.array(texts, pa.string()), seen


def test_pieces_hold_every_row_once_and_bounded_text(monkeypatch):
    tk, column, seen = _wide(monkeypatch)
    runs = list(tk.pieces(column))
    assert [k for r in runs for k in range(r.start, r.stop)] == list(range(len(column)))
    for r in runs:
        assert sum(len((t or "").encode()) for t in column[r].to_pylist()) <= 10_000 or r.stop - r.start == 1
    assert list(tk.pieces(column[:0])) == []


def test_snap_takes_a_batch_in_pieces(monkeypatch):
    import pyarrow as pa

    tk, column, seen = _wide(monkeypatch)
    spans = pa.array([[1, 7]] * len(column), pa.list_(pa.int32())), pa.array([[2, 9]] * len(column), pa.list_(pa.int32()))
    found = tk.snapped(column, *spans).to_pylist()
    assert len(seen) > 10 and sum(seen) < 2 * column.nbytes + 2000
    monkeypatch.setattr(tk, "PIECE", 1 << 40)
    assert found == tk.snapped(column, *spans).to_pylist() and found[5][0]["text"] == "Zoë"


def test_offsets_and_gazetteer_yield_a_batch_for_each_piece(spark, monkeypatch):
    import pyarrow as pa

    _, column, seen = _wide(monkeypatch)
    batch = pa.record_batch([pa.array([str(k) for k in range(len(column))]), column], ["doc_id", "text"])
    docs = spark.createDataFrame([("0", "Zoë")], "doc_id string, text string")
    names = spark.createDataFrame([("Person", "Zoë")], "label string, name string")
    runs, plain = [], type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: runs.append(f) or plain(self, f, schema))
    extract.token_offsets(docs), extract.extract_gazetteer(docs, names)
    for run, each in zip(runs, (360, 120), strict=True):
        seen.clear()
        found = list(run(iter([batch])))
        assert len(found) > 10 and max(seen) < 100_000
        assert sum(map(len, found)) == 40 * each + (each == 360)
