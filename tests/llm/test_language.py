import numpy as np
import pytest

from entloom.llm import op5_language as op

from .helpers import DOC, awkward, clashing, empty

TALK = {
    "en": "the of and to in that it was for with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont aux avec mais être cette été aussi leur comme ont ses où après très même".split(),
}


def say(lang, seed, n=80):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(TALK[lang], n)).capitalize() + "."


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 * i + k, say(lang, 100 * i + k), lang, "s", 0) for i, lang in enumerate(TALK) for k in range(60)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def model_b(docs):
    return op.fitted(docs)


def found(model_b, spark, *texts):
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC)
    return [(r.language, r.accepted) for r in op.identify(df, model_b).orderBy("doc_id").collect()]


def test_held_out_accuracy(spark, model_b):
    want = [lang for lang in TALK for _ in range(40)]
    got = found(model_b, spark, *[say(lang, 9000 + k + 100 * i) for i, lang in enumerate(TALK) for k in range(40)])
    assert np.mean([g[0] == w for g, w in zip(got, want, strict=True)]) >= 0.97 and all(g[1] for g in got)


def test_whole_text_counts_and_noise_goes(spark, model_b):
    rng = np.random.default_rng(0)
    late = "1234 5678 " * 200 + say("fr", 1, 4000)
    mixed = say("en", 1, 500) + " " + say("de", 2, 500)
    upper = say("en", 3, 200).upper()
    code = "".join(rng.choice(list("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/"), 4000))
    got = found(model_b, spark, late, mixed, upper, "0123 456 !!", code, None, "", " \n ")
    assert got[0] == ("fr", True) and got[1][1] and got[2] == ("en", True)
    assert [g for g in got[3:]] == [(op.NONE, False)] * 5


def test_windows_hold_every_gram():
    rng = np.random.default_rng(4)
    for n in (0, 1, 3, op.WINDOW, op.WINDOW + 1, 5 * op.WINDOW + 7):
        raw = rng.integers(97, 123, n).astype(np.uint8)
        x, doc, real = op.windows(raw, np.array([0, n]))
        grams = {x[i, j : j + op.WIDEST].tobytes() for i in range(len(x)) for j in range(op.WINDOW - op.WIDEST + 1)}
        assert all(raw[j : j + op.WIDEST].tobytes() in grams for j in range(n - op.WIDEST + 1))
        assert (n == 0) == (len(x) == 0) and (doc == 0).all() and (real <= op.WINDOW).all()


def test_gradient_is_right():
    rng = np.random.default_rng(1)
    x, y = rng.integers(97, 123, (4, op.WINDOW)).astype(np.uint8), np.array([0, 1, 2, 0])
    p = {"embed": rng.normal(size=(256, op.EMBED)), "filters": rng.normal(size=(op.WIDEST * op.EMBED, op.FILTERS)) * op._mask(), "bias": rng.normal(size=op.FILTERS), "out": rng.normal(size=(op.FILTERS, 3)) * 0.1, "out_bias": np.zeros(3)}
    weight = np.ones(3)

    def loss():
        m = op.Model(["a", "b", "c"], p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"])
        h = (op._grams(m.embed[x]) @ m.filters).reshape(4, -1, op.FILTERS).max(axis=1)
        z = np.maximum(h + m.bias, 0) @ m.out + m.out_bias
        z -= z.max(axis=1, keepdims=True)
        return -(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(4), y].mean()

    g = op._gradient(p, x, y, weight, op._mask())
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old = p[k][at]
        p[k][at] = old + 1e-5
        up = loss()
        p[k][at] = old - 1e-5
        down = loss()
        p[k][at] = old
        assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=2e-2, abs=1e-6), k


def test_awkward_rows(spark, model_b):
    d = awkward(spark)
    got = op.identify(clashing(d), model_b)
    assert got.count() == d.count() and not any(r.accepted for r in got.filter("doc_id in (2, 3, 4, 11)").collect())
    out = op.stage(spark, clashing(d), "")
    assert out.columns == clashing(d).columns and {2, 3, 4, 11}.isdisjoint({r.doc_id for r in out.collect()})
    assert op.identify(empty(spark)).count() == 0 and op.stage(spark, empty(spark), "").count() == 0


def test_forward_pass_matches_a_plain_convolution():
    """Every filter at every place, of its own width only, by loops over bytes."""
    rng = np.random.default_rng(7)
    m = op.train([say(lang, k, 30) for lang in ("en", "fr") for k in range(3)], ["en"] * 3 + ["fr"] * 3)
    x = rng.choice(np.frombuffer(b"abcdefgh  etaoin", np.uint8), (3, op.WINDOW))
    got = op.log_probs(m, x)
    filters = m.filters.reshape(op.WIDEST, op.EMBED, op.FILTERS)
    width = [w for w, n in op.WIDTHS.items() for _ in range(n)]
    for row, mine in zip(x, got, strict=True):
        pooled = [max(sum(float(m.embed[row[i + j]] @ filters[j, :, f]) for j in range(width[f])) for i in range(op.WINDOW - op.WIDEST + 1)) for f in range(op.FILTERS)]
        z = np.maximum(np.array(pooled) + m.bias, 0) @ m.out + m.out_bias
        assert np.allclose(mine, z - np.log(np.exp(z).sum()), atol=1e-3)
    for f, w in enumerate(width):
        assert not filters[w:, :, f].any()


def test_all_windows_of_a_training_text_train(monkeypatch):
    seen = []
    gradient = op._gradient
    monkeypatch.setattr(op, "_gradient", lambda p, x, *a: seen.append(x) or gradient(p, x, *a))
    text = say("en", 1, 2000)
    op.train([text], ["en"])
    raw = np.frombuffer(text.encode(), np.uint8)
    windows, _, _ = op.windows(raw, np.array([0, len(raw)]))
    rows = {r.tobytes() for x in seen for r in x}
    assert len(windows) > 30 and all(w.tobytes() in rows for w in windows)


def test_confidence_gate(spark, model_b):
    df = spark.createDataFrame([(1, say("en", 1, 300) + " " + say("de", 2, 300) + " " + say("fr", 3, 300), None, None, None), (2, say("en", 4), None, None, None)], DOC)
    assert [r.accepted for r in op.identify(df, model_b).orderBy("doc_id").collect()] == [True, True]
    sure = {r.doc_id: (r.confidence, r.accepted) for r in op.identify(df, model_b, least=0.95).collect()}
    assert all(accepted == (confidence >= 0.95) for confidence, accepted in sure.values())
