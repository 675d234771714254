import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from entloom.llm import bytesx as bx
from entloom.llm import op6_neardup as op

from .helpers import DOC, awkward, clashing, empty, prose


def vectors(texts):
    """Weighted shingles of each text, as the operator has them."""
    enc = [(t or "").encode() for t in texts]
    data, off = np.frombuffer(b"".join(enc), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])])
    doc, ids, times = bx.shingles(data, off, op.NGRAM)
    df = np.bincount((ids & np.uint64((1 << op.DF_BITS) - 1)).astype(np.int64), minlength=1 << op.DF_BITS)
    w = op.weights(ids, times, op.idf_table(df, len(texts)))
    return [dict(zip(ids[doc == k].tolist(), w[doc == k].astype(float).tolist(), strict=True)) for k in range(len(texts))]


def jaccard(a, b):
    both = sum(min(v, b[k]) for k, v in a.items() if k in b)
    return both / max(sum(a.values()) + sum(b.values()) - both, 1e-12) if a and b else 0.0


def edited(text, share, seed):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


def corpus():
    rows, k = [], 0
    for family in range(30):
        base = prose(1000 + family, 40 + 20 * (family % 5))
        rows.append((k, base))
        for copy in range(family % 6):
            k += 1
            rows.append((k, base if copy == 3 else edited(base, 0.02 + 0.03 * copy, k)))
        k += 1
    rows += [(5000 + j, prose(7000 + j, 50)) for j in range(60)]
    passage = prose(99, 60)  # many documents share it; it is a small part of each
    rows += [(6000 + j, prose(8000 + j, 200) + " " + passage) for j in range(40)]
    rows += [(7000 + j, edited(rows[0][1] + prose(3, 100), 0.03, j)) for j in range(50)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOC)


def brute_groups(rows, threshold=op.THRESHOLD):
    v = vectors([t for _, t in rows])
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    good = [(a, b) for a, b in combinations(range(len(rows)), 2) if jaccard(v[a], v[b]) >= threshold]
    for a, b in good:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return good, [find(k) for k in range(len(rows))]


def test_against_brute_force(spark):
    rows = sorted(corpus())
    good, want = brute_groups(rows)
    got = {r.doc_id: r for r in op.near_duplicates(frame(spark, rows)).collect()}
    place = {i: k for k, (i, _) in enumerate(rows)}
    mine = [place[got[i].duplicate_of] if i in got else place[i] for i, _ in rows]
    assert np.mean([mine[a] == mine[b] for a, b in good]) >= 0.97
    assert all(want[k] == want[m] for k, m in enumerate(mine))  # nothing joined that brute force keeps apart
    sizes = defaultdict(int)
    for m in mine:
        sizes[m] += 1
    assert all(r.group_size == sizes[place[r.duplicate_of]] for r in got.values())
    clean = {i for i, _ in rows if 5000 <= i < 7000}
    assert not clean & set(got)


def test_sampling_agrees_as_often_as_vectors_are_alike():
    texts = [prose(1, 400), edited(prose(1, 400), 0.08, 2), prose(3, 400)]
    v = vectors(texts)
    keys = [np.array(list(x), dtype=np.uint64) for x in v]
    s = [op.sample(k, np.array(list(x.values()), dtype=np.float32), np.array([0]))[0] for k, x in zip(keys, v, strict=True)]
    assert abs(np.mean(s[0] == s[1]) - jaccard(v[0], v[1])) < 0.2 and np.mean(s[0] == s[2]) < 0.1
    assert (op.sample(keys[0], np.array(list(v[0].values()), dtype=np.float32), np.array([0]))[0] == s[0]).all()


def test_heavier_weights_are_sampled_more():
    rng = np.random.default_rng(1)
    hits = 0
    for k in range(60):
        ids = rng.integers(1, 1 << 44, 2, dtype=np.uint64)
        both = op.sample(ids, np.array([3.0, 1.0], np.float32), np.array([0]))[0]
        alone = op.sample(ids[:1], np.array([3.0], np.float32), np.array([0]))[0]
        hits += np.mean(both == alone)
    assert abs(hits / 60 - 0.75) < 0.05


def test_awkward_rows(spark):
    docs = awkward(spark)
    for d in (docs, clashing(docs)):
        got = {(r.doc_id, r.duplicate_of, r.group_size) for r in op.near_duplicates(d).collect()}
        assert got == {(7, 1, 2)}
        out = op.stage(spark, d, "")
        assert out.columns == d.columns
        assert sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect()) == [(False, k) for k in (1, 2, 3, 4, 5, 6, 9, 10, 11)] + [(True, 0)]
    assert op.near_duplicates(empty(spark)).count() == 0 and op.stage(spark, empty(spark), "").count() == 0


def test_one_of_many_exact_copies_stays(spark):
    rows = [(k, prose(1)) for k in range(500, 0, -1)] + [(1000, prose(2))]
    out = op.stage(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in out.collect()) == [1, 1000]


def plain_words(text):
    """Words character by character."""
    inside = lambda spans, c: any(lo <= ord(c) <= hi for lo, hi in spans)
    out, word = [], ""
    for c in text + " ":
        alone = ord(c) > 127 and inside(bx.ALONE, c)
        if (c.isascii() and (c.isalnum() or c == "_")) or (ord(c) > 127 and not alone and not inside(bx.BETWEEN, c)):
            word += c.lower() if ord(c) < 0x100 else c
            continue
        if word:
            out.append(word)
        if alone:
            out.append(c)
        word = ""
    return out


TEXTS = ["", "one", "Two words", "a b c a b c a b c", "ÀÉÎ naïve—dash “quoted” l’eau", "汉字测试。汉字", "ภาษาไทย and more", "カタカナ、ひらがな", "x_1 ÿ × ÷ µ ª", "mixed 汉a字b", "\u3000full\uff0cwidth ＡＢ", "emoji 😀 end", "Ünïcödé" * 3, "한국어 단어"]


def test_words_and_shingles_match_a_plain_version():
    texts = [*TEXTS, *(prose(k, 40) for k in range(5)), "".join(TEXTS)]
    enc = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(enc), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])])
    start, end, doc = bx.words(data, off)
    low = bx.lower(data).tobytes()
    got = [[low[a:b].decode() for a, b, d in zip(start, end, doc, strict=True) if d == k] for k in range(len(texts))]
    assert got == [plain_words(t) for t in texts]
    hashes = bx.word_hashes(data, start, end)
    flat = [w for ws in got for w in ws]
    assert len(set(zip(flat, hashes.tolist(), strict=True))) == len(set(flat)) == len(set(hashes.tolist()))
    sdoc, ids, times = bx.shingles(data, off, 3)
    name = {}
    for k, ws in enumerate(got):
        grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)] or ([tuple(ws)] if ws else [])
        want = sorted(grams.count(g) for g in set(grams))
        mine = sdoc == k
        assert sorted(times[mine].tolist()) == want
        name[k] = (set(grams), set(ids[mine].tolist()))
    for a, b in combinations(name, 2):  # texts share as many ids as they share grams
        assert len(name[a][1] & name[b][1]) == len(name[a][0] & name[b][0])


def test_near_copies_in_a_script_without_blanks(spark):
    import random

    r = random.Random(3)
    base = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(200))
    changed = base[:100] + "变" + base[101:]
    other = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(200))
    assert {(x.doc_id, x.duplicate_of) for x in op.near_duplicates(frame(spark, [(1, base), (2, changed), (3, other)])).collect()} == {(2, 1)}


def test_one_doc_id_with_several_texts_loses_none(spark):
    quick = prose(2)
    rows = [(5, prose(1)), (5, quick), (7, quick), (8, None), (8, prose(3)), (9, prose(4)), (9, prose(4)), (9, ""), (4, prose(1)), (10, prose(5)), (10, prose(5).upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", k % 2) for k, (i, t) in enumerate(rows)], DOC)
    assert {tuple(r) for r in op.near_duplicates(docs).collect()} == {(5, 4, 2), (7, 5, 2)}
    for d in (docs, clashing(docs)):
        out = [(r.doc_id, r.text) for r in op.stage(spark, d, "").collect()]
        assert len(out) == len(set(out)) == 7
        assert {x for x in out if x[0] != 10} == {(5, quick), (8, None), (8, prose(3)), (9, prose(4)), (9, ""), (4, prose(1))}
        assert {t.lower() for i, t in out if i == 10} == {prose(5).lower()}
        assert {t.lower() for t in (t for _, t in rows if t)} == {t.lower() for _, t in out if t}  # every text, or a copy of it, is left


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    """Members that the lead didn't join, in buckets larger than one round's leads."""
    monkeypatch.setattr(op, "LEADS_GROW", 2)
    monkeypatch.setattr(op, "SALT_ROWS", 3)
    passage = prose(50, 90)
    rows = [(100 * f + c, edited(passage + " " + prose(60 + f, 60), 0.01 * c, 100 * f + c)) for f in range(12) for c in range(4)]
    good, want = brute_groups(rows)
    got = {r.doc_id: r.duplicate_of for r in op.near_duplicates(frame(spark, rows)).collect()}
    place = {i: k for k, (i, _) in enumerate(rows)}
    mine = [place[got.get(i, i)] for i, _ in rows]
    assert np.mean([mine[a] == mine[b] for a, b in good]) >= 0.97 and all(want[k] == want[m] for k, m in enumerate(mine))


def test_idf_falls_with_every_document():
    idf = op.idf_table(np.arange(1, 1001), 1000)
    assert (np.diff(idf) < 0).all() and abs(idf[-1] - np.log1p(1 / (1 + op.IDF_SMOOTH))) < 1e-6


def test_sql_says_the_same(spark):
    duckdb = __import__("duckdb")
    rows = sorted(corpus()) + [(9000 + k, t) for k, t in enumerate(TEXTS)] + [(9900, TEXTS[-1]), (9901, TEXTS[5])]
    documents = frame(spark, rows).toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(op.SQL).fetchall()) == sorted(tuple(r) for r in op.near_duplicates(frame(spark, rows)).collect())
