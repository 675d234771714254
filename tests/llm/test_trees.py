import numpy as np
import pytest
from pyspark.sql import functions as F

from entloom.llm import gbt
from entloom.llm import op2_quality as quality
from entloom.llm import op4_urls as urls

from .helpers import DOC, awkward, clashing, empty, prose


def auc(y, p):
    order = np.argsort(p, kind="stable")
    rank = np.empty(len(p))
    rank[order] = np.arange(1, len(p) + 1)
    n = (y == 1).sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def walk(t, x):
    """One row at a time, node by node."""
    out = []
    for row in x.astype(np.float32):
        s = t.base
        for f, cut, leaf in zip(t.feature, t.threshold, t.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + (2 if row[f[k]] > cut[k] else 1)
            s += leaf[k - len(f)]
        out.append(1 / (1 + np.exp(-s)))
    return np.array(out)


def test_fit_learns_and_traversal_matches_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 6))
    x[::17, 2] = np.nan
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(3000) < 0.05)).astype(float)
    t = gbt.fit(x[:2000], y[:2000])
    p = t.score(x[2000:])
    assert auc(y[2000:], p) > 0.93
    assert np.allclose(p[:60], walk(t, x[2000:2060]))


def test_fit_of_little():
    assert gbt.fit(np.zeros((0, 3)), np.zeros(0)).score(np.zeros((2, 3))).tolist() == [0.5, 0.5]
    assert (gbt.fit(np.ones((5, 3)), np.ones(5)).score(np.zeros((2, 3))) > 0.99).all()
    assert np.allclose(gbt.fit(np.ones((50, 2)), np.arange(50) % 2).score(np.ones((1, 2))), 0.5)


def plain_statistics(text):
    words = __import__("re").findall(r"[\w]+", text, __import__("re").A)
    raw = text.encode()
    return {"log_bytes": np.log1p(len(raw)), "log_words": np.log1p(len(words)), "share_upper": sum(c.isupper() for c in text) / max(1, len(raw)), "share_digit": sum(c.isdigit() for c in text) / max(1, len(raw)), "word_mean": np.mean([len(w) for w in words]) if words else 0, "distinct_words": len({w.lower() for w in words}) / max(1, len(words)), "repeated_lines": 1 - len(set(text.split("\n"))) / max(1, len(text.split("\n"))) if text else 0}


def test_statistics_match_a_plain_version():
    texts = ["Hello big World 123", "", "a a a\na a a\nb", "ABC DEF!", "x" * 5000, prose(1, 3000)]
    enc = [t.encode() for t in texts]
    got = quality.statistics(np.frombuffer(b"".join(enc), np.uint8), np.concatenate([[0], np.cumsum([len(e) for e in enc])]))
    for row, text in zip(got, texts, strict=True):
        for name, want in plain_statistics(text).items():
            assert row[quality.FEATURES.index(name)] == pytest.approx(want, rel=1e-4, abs=1e-5), (name, text[:20])
    assert np.isfinite(got).all()


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(k, prose(k, 60) if k % 3 else " ".join(f"{w}###" for w in prose(k, 60).split()), "en", "s", 1) for k in range(400)]
    docs = spark.createDataFrame(rows, DOC)
    labels = docs.filter("doc_id < 300").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return docs, labels


def test_quality_on_held_out_documents(labelled):
    docs, labels = labelled
    rows = quality.classify(docs, labels).filter("doc_id >= 300").collect()
    assert all(r.keep == (r.doc_id % 3 != 0) for r in rows) and len(rows) == 100


def test_quality_of_awkward_rows(spark, labelled):
    _, labels = labelled
    d = awkward(spark)
    for docs in (d, clashing(d)):
        got = quality.classify(docs, clashing(labels.withColumnRenamed("quality", "q")).drop("quality").withColumnRenamed("q", "quality"))
        assert got.count() == d.count() and got.filter("quality is null or keep is null").count() == 0
    assert quality.classify(empty(spark), labels).count() == 0
    none = quality.classify(d, labels.limit(0)).collect()
    assert {r.quality for r in none} == {0.5}
    odd = labels.union(spark.createDataFrame([(None, 1, 0), (1, None, None)], "doc_id long, quality int, toxic int"))
    assert quality.classify(d, odd).count() == d.count()


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_urls_on_held_out_hosts(spark):
    good = [f"https://www.{w}.example.{s}/{a}/{k}" for k, (w, s, a) in enumerate((w, s, a) for w in ("news", "garden", "school", "museum", "river", "music") for s in ("com", "org", "net") for a in ("en", "de", "fr", "es"))]
    bad = [f"http://{w}-{v}{k}.example.{s}/?a={k}&b=2&c={k}x" for k, (w, v, s) in enumerate((w, v, s) for w in ("cheap", "win", "free", "best") for v in ("pills", "casino", "bets") for s in ("com", "org", "biz") for _ in range(2))]
    hold = lambda xs: (xs[: len(xs) * 2 // 3], xs[len(xs) * 2 // 3 :])
    (g1, g2), (b1, b2) = hold(good), hold(bad)
    labels = spark.createDataFrame([(u, 0) for u in g1] + [(u, 1) for u in b1], "url string, label int")
    got = urls.filter_urls(pages(spark, [(k, u, "") for k, u in enumerate(g2 + b2)]), labels).orderBy("page_id").collect()
    assert np.mean([r.blocked == (r.page_id >= len(g2)) for r in got]) >= 0.95


def test_url_parts(spark):
    row = pages(spark, [(1, "HTTPS://user@WWW.Ex.example.co.uk:80/a/b?x=1&y=2#f", "")]).select(*(c.alias(k) for k, c in urls.parts(F.col("url")).items())).first()
    assert (row.host, row.path, row.suffix) == ("www.ex.example.co.uk", "/a/b", "co.uk")
    hosts = {"a.example.com": "com", "example.org.": "org", "x.y.de": "de", "a.com.au": "com.au", "com.au": "au", "localhost": "", "10.0.0.1": "", "x.museum": "museum", "": ""}
    got = pages(spark, [(k, f"http://{h}/p", "") for k, h in enumerate(hosts)]).select("page_id", urls.parts(F.col("url"))["suffix"]).orderBy("page_id").collect()
    assert [r[1] for r in got] == list(hosts.values())


def plain_lexical(url, known):
    """The features of one URL, by Python's own string functions."""
    from collections import Counter
    from math import log2

    url = url.strip(" ").lower()
    rest = url.split("://", 1)[1] if "://" in url else url
    cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
    host, path = rest[:cut].split("@")[-1].split(":")[0], rest[cut:].split("?")[0].split("#")[0]
    labels = host.split(".")
    second = len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in "ac co com edu gob gov net nom or org".split()
    suffix = (".".join(labels[-2:]) if second else labels[-1]) if len(labels) > 1 and not labels[-1].isdigit() else ""
    entropy = lambda t: -sum(n / len(t) * log2(n / len(t)) for n in Counter(t).values()) if t else 0
    digits = lambda t: sum(c.isdigit() for c in t)
    share, rate = known.get(suffix, (0.0, known[""][1]))
    return [
        len(url), path.count("/"), digits(url) / max(len(url), 1), entropy(url), url.count("="), "#" in url, len(host), host.count(".") + bool(host), digits(host), entropy(host), sum(host.count(v) for v in "aeiou") / max(len(host), 1), len(path),
        *(url.count(c) for c in "/?&=-._%"), *(host.count(c) for c in "-."), share, rate,
    ]


def test_lexical_features_match_a_plain_version(spark):
    found = ["http://www.garden.example.com/en/12?a=1&b=2#top", "https://u:p@cheap-pills.example.co.uk:8080/x//y.html", "HTTP://10.0.0.1/?q=%20", "localhost", "x.de", "https://a.b.c.example.museum/" + "9" * 300, "//odd?x#y"]
    ends = ["com", "com", "org", "co.uk", "de", "com"]
    y = np.array([0, 1, 0, 1, 0, 0])
    known = urls.suffix_statistics(ends, y)
    for s in set(ends):
        at = [k for k, x in enumerate(ends) if x == s]
        assert known[s] == pytest.approx((len(at) / 6, (sum(y[at]) + 20 * 2 / 6) / (len(at) + 20)))
    assert known[""] == pytest.approx((0, 2 / 6))
    rows = pages(spark, [(k, u, "") for k, u in enumerate(found)]).select("page_id", *(c.alias(k) for k, c in urls.parts(F.col("url")).items())).orderBy("page_id").toArrow()
    got = urls.lexical(*(rows[k].combine_chunks() for k in ("url", "host", "path", "suffix")), known)
    assert got.shape[1] == len(urls.FEATURES)
    assert np.allclose(got, np.array([plain_lexical(u, known) for u in found], dtype=np.float32), atol=1e-4)


def test_url_awkward_rows(spark):
    rows = [(1, "http://spam-farm.example.org/x", "h"), (2, "", "h"), (3, None, None), (4, "http://ok.example.com/" + "a" * 50_000, "h"), (None, "nonsense", ""), (5, "http://ok.example.com/", "h"), (5, "http://ok.example.com/", "h")]
    p = pages(spark, rows)
    for d in (p, p.withColumn("score", F.lit(1)).withColumn("label", F.lit(2)).withColumn("found", F.lit("x"))):
        got = urls.filter_urls(d, urls.seed_labels(d)).collect()
        assert len(got) == 7 and all(r.blocked and r.score == 1.0 for r in got if not r.url)
    assert urls.filter_urls(p.limit(0), urls.seed_labels(p.limit(0))).count() == 0
    labels = {r.url: r.label for r in urls.seed_labels(pages(spark, [(1, "http://blog.spam-farm.example.org/", ""), (2, "http://notspam-farm.example.org/", "")])).collect()}
    assert list(labels.values()) == [1, 0]


def test_listed_sites_are_blocked_under_any_suffix_and_unlisted_rows_do_not_train(spark, tmp_path):
    other = ["http://spam-farm.example.com/en/1", "https://www.adult-x.example.net/de/20.html", "http://m.ads-track.example.org/", "http://casino-win.example.co.uk/x?a=1"]
    labels = urls.seed_labels(pages(spark, [(k, u, "") for k, u in enumerate(other)])).collect()
    assert [r.label for r in labels] == [1] * 4
    unknown = ["http://www.river.example.com/en/7", "http://cheap-bets.example.com/en/7"] * 30
    for name, table in (("mixed", other + unknown), ("unlisted", unknown)):
        pages(spark, [(k, u, "") for k, u in enumerate(table)]).write.parquet(str(tmp_path / name / "pages.parquet"))
        got = {r.url: r for r in urls.query(spark, str(tmp_path / name)).collect()}
        assert all(got[u].blocked for u in other if u in got)
        assert not got[unknown[0]].blocked and got[unknown[1]].blocked
