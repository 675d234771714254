"""Language identification by a byte convolutional network (operator 5).

The network reads fixed-length windows of bytes: an embedding of each byte,
filters of several widths, the maximum over the window, and a softmax over the
languages and one class for what is no language.  It is trained here with numpy
on all windows of a bounded sample of labelled documents; scoring covers every
window of every document in batches, never a prefix.

Filters narrower than the widest are held as wide filters with zeros, so that one
matrix product serves all widths.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import bytesx as bx
from .names import free
from .store import small_batches

WINDOW = 256
EMBED = 8
WIDTHS = {2: 12, 3: 16, 4: 20}
WIDEST = max(WIDTHS)
FILTERS = sum(WIDTHS.values())
#: At most so many documents of each language train the network, chosen by the hash of their ids.
TRAIN_DOCS = 250
EPOCHS = 3
#: A document has a language if all languages together have this probability.
MIN_SPOKEN = 0.5
#: Documents whose best language has less than this are not accepted. 0 is off: a text in several languages has a low best one and is still text.
MIN_CONFIDENCE = 0.0
NONE = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    classes: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDEST * EMBED x FILTERS
    bias: np.ndarray
    out: np.ndarray  # FILTERS x classes
    out_bias: np.ndarray


def _mask() -> np.ndarray:
    m = np.zeros((WIDEST, EMBED, FILTERS), dtype=np.float32)
    at = 0
    for width, n in WIDTHS.items():
        m[:width, :, at : at + n] = 1
        at += n
    return m.reshape(WIDEST * EMBED, FILTERS)


def windows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window matrix of all bytes in lower case, the document of each window, and its number of real bytes.

    Windows overlap by WIDEST - 1 bytes, so that every n-gram of a document lies
    in one; the last of a document is filled with spaces.
    """
    size = np.diff(off)
    step = WINDOW - WIDEST + 1
    n = np.where(size > 0, np.maximum(1, -(-(size - WIDEST + 1) // step)), 0)
    doc = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = off[:-1][doc] + k * step
    real = np.minimum(WINDOW, off[1:][doc] - start)
    padded = np.append(bx.lower(data), np.full(WINDOW, 32, np.uint8))
    x = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start]
    short = np.flatnonzero(real < WINDOW)
    if len(short):
        x[short] = np.where(np.arange(WINDOW) < real[short, None], x[short], 32)
    return x, doc, real


def _grams(e: np.ndarray) -> np.ndarray:
    n, w, d = e.shape
    s = e.strides
    return np.lib.stride_tricks.as_strided(e, (n, w - WIDEST + 1, WIDEST * d), (s[0], s[1], s[2])).reshape(-1, WIDEST * d)


def log_probs(m: Model, x: np.ndarray) -> np.ndarray:
    """Log probabilities of the classes, for each window."""
    out = np.empty((len(x), len(m.classes)), dtype=np.float32)
    for lo in range(0, len(x), 32):
        part = x[lo : lo + 32]
        h = (_grams(m.embed[part]) @ m.filters).reshape(len(part), -1, FILTERS).max(axis=1)
        z = np.maximum(h + m.bias, 0) @ m.out + m.out_bias
        z -= z.max(axis=1, keepdims=True)
        out[lo : lo + 32] = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
    return out


def train(texts: list[str], labels: list[str], seed: int = 5) -> Model:
    """A network for the distinct labels and for NONE, whose examples are noise made here.

    Repeated texts count as often as they come.  Without any text the network
    knows NONE alone.
    """
    rng = np.random.default_rng(seed)
    classes = [*sorted(set(labels)), NONE]
    xs, ys = [], []
    for text, label in zip(texts, labels, strict=True):
        raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
        x, _, _ = windows(raw, np.array([0, len(raw)]))
        xs.append(x)
        ys += [classes.index(label)] * len(x)
        if len(raw) > 40:  # short texts are known too
            cut = int(rng.integers(20, min(len(raw), WINDOW)))
            at = int(rng.integers(0, len(raw) - cut + 1))
            short = np.full((1, WINDOW), 32, np.uint8)
            short[0, :cut] = raw[at : at + cut]
            xs.append(short)
            ys.append(classes.index(label))
            mixed = short.copy()  # and so are texts between numbers and signs
            words = np.flatnonzero(short[0] == 32)[:-1]
            for at in rng.choice(words, min(len(words), int(rng.integers(1, 5))), replace=False):
                run = rng.choice(_DIGITS, int(rng.integers(4, 24)))
                mixed[0] = np.concatenate([mixed[0, : at + 1], run, mixed[0, at:]])[:WINDOW]
            xs.append(mixed)
            ys.append(classes.index(label))
    n_noise = max(8, len(ys) // max(1, len(classes)))
    xs.append(_noise(rng, n_noise))
    ys += [len(classes) - 1] * n_noise
    x, y = np.concatenate(xs), np.array(ys)
    p = {
        "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        "filters": (rng.normal(0, 0.3, (WIDEST * EMBED, FILTERS)) * _mask()).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32),
        "out": rng.normal(0, 0.2, (FILTERS, len(classes))).astype(np.float32),
        "out_bias": np.zeros(len(classes), np.float32),
    }
    share = np.bincount(y, minlength=len(classes))
    weight = (len(y) / len(classes) / np.maximum(share, 1)).astype(np.float32)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    mask, t = _mask(), 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), 32):
            at = order[lo : lo + 32]
            t += 1
            for k, g in _gradient(p, x[at], y[at], weight, mask).items():
                a, b = moment[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                rate = 0.01 * (1 - 0.8 * epoch / EPOCHS)
                p[k] -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    return Model(classes, p["embed"], p["filters"], p["bias"], p["out"], p["out_bias"])


def _gradient(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    n, span = len(x), WINDOW - WIDEST + 1
    grams = _grams(p["embed"][x])
    h = (grams @ p["filters"]).reshape(n, span, FILTERS)
    top = h.argmax(axis=1)
    pooled = np.take_along_axis(h, top[:, None, :], axis=1)[:, 0] + p["bias"]
    act = np.maximum(pooled, 0)
    z = act @ p["out"] + p["out_bias"]
    e = np.exp(z - z.max(axis=1, keepdims=True))
    dz = e / e.sum(axis=1, keepdims=True)
    dz[np.arange(n), y] -= 1
    dz *= weight[y][:, None] / n
    dh = (dz @ p["out"].T) * (pooled > 0)
    picked = grams[(np.arange(n)[:, None] * span + top).ravel()].reshape(n, FILTERS, -1)
    d_filters = np.einsum("nf,nfk->kf", dh, picked) * mask
    d_gram = (dh[:, :, None] * p["filters"].T[None]).reshape(n, FILTERS, WIDEST, EMBED)
    d_embed = np.zeros((256, EMBED), np.float32)
    for j in range(WIDEST):
        np.add.at(d_embed, np.take_along_axis(x, top + j, axis=1).ravel(), d_gram[:, :, j].reshape(-1, EMBED))
    return {"embed": d_embed, "filters": d_filters, "bias": dh.sum(axis=0), "out": act.T @ dz, "out_bias": dz.sum(axis=0)}


_DIGITS = np.frombuffer(b"0123456789012345678901234567890123456789.-+() :=", dtype=np.uint8)


def _noise(rng: np.random.Generator, n: int) -> np.ndarray:
    """Windows that are no language: digits, symbols, encoded bytes, one byte again and again."""
    kinds = [b"0123456789 ", b"0123456789abcdef", b"!#$%&*+-/<=>?@[]^_{}|~;: ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", bytes(range(128, 256)), b" \t\n."]
    x = np.full((n, WINDOW), 32, np.uint8)
    for i in range(n):
        kind = np.frombuffer(kinds[i % len(kinds)], dtype=np.uint8)
        size = int(rng.integers(4, WINDOW + 1))
        x[i, :size] = rng.choice(kind, size) if i % 12 else rng.choice(kind)
    return x


def training_rows(docs: DataFrame, per_class: int = TRAIN_DOCS) -> tuple[list[str], list[str]]:
    """Texts and labels of at most `per_class` documents of each language, by the hash of doc_id.

    Ids are chosen before any text is read.  Rows without a label, id or text don't train.
    """
    label = F.col("lang").cast("string").alias("lang")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), label).filter("doc_id is not null and lang is not null and lang <> ''")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = ids.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= per_class).select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), label, F.col("text").cast("string").alias("text")).filter("text is not null and text <> '' and lang is not null and lang <> ''")
    found = sorted((r.doc_id, r.lang, r.text) for r in rows.join(F.broadcast(chosen), "doc_id", "left_semi").collect())
    return [r[2] for r in found], [r[1] for r in found]


def classify(model_b, text: Column) -> Column:
    """struct(language, confidence) of a text column.

    Windows count by their letters, so numbers and signs between words decide
    nothing.  Null, empty and letterless texts are NONE with confidence 1.  Ties
    between languages go to the first by name.
    """

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m: Model = model_b.value
        names, none = np.array(m.classes), len(m.classes) - 1
        for column in it:
            data, off = bx.buffers(column)
            best, sure = np.full(len(column), none), np.ones(len(column))
            for lo, hi in bx.slices(off):
                x, doc, _ = windows(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                if not len(doc):
                    continue
                letters = _LETTER[x].sum(axis=1).astype(np.float64)
                some = letters > 0
                score = log_probs(m, x[some]).astype(np.float64) * letters[some, None]
                total = np.bincount(doc[some], letters[some], minlength=hi - lo)
                z = np.stack([np.bincount(doc[some], score[:, c], minlength=hi - lo) for c in range(len(m.classes))], axis=1) / np.maximum(total, 1)[:, None]
                e = np.exp(z - z.max(axis=1, keepdims=True))
                e /= e.sum(axis=1, keepdims=True)
                spoken = (total > 0) & (1 - e[:, none] >= MIN_SPOKEN) & (none > 0)
                top = e[:, :none].argmax(axis=1) if none else np.zeros(hi - lo, np.int64)
                best[lo:hi] = np.where(spoken, top, none)
                sure[lo:hi] = np.where(spoken, e[np.arange(hi - lo), top], np.where(total > 0, e[:, none], 1.0))
            yield pa.StructArray.from_arrays([pa.array(names[best], pa.string()), pa.array(np.round(sure, 4))], ["language", "confidence"])

    return F.arrow_udf(run, "language string, confidence double").asNondeterministic()(text.cast("string"))


def accepted(found: Column, least: float = MIN_CONFIDENCE) -> Column:
    return (found["language"] != NONE) & (found["confidence"] >= least)


def fitted(docs: DataFrame):
    small_batches(docs.sparkSession)
    return docs.sparkSession.sparkContext.broadcast(train(*training_rows(docs)))


def identify(docs: DataFrame, model_b=None, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, language, confidence, accepted) of every row, null doc_ids and repeated rows too.

    A document is accepted when it has a language, in which it is `least` sure; one
    of several languages has one too.  Text in a language that no label names gets
    the name of a labelled one; without any label nothing has a language.  Null,
    empty and letterless texts have none.  Very long texts are scored whole; a tie
    goes to the first language by name.  No rows give no rows.  Columns but doc_id,
    text and lang are not read, so their names don't matter.
    """
    model_b = model_b or fitted(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), classify(model_b, F.col("text")).alias("found"))
    return rows.select("doc_id", "found.language", "found.confidence", accepted(F.col("found"), least).alias("accepted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` without the rows that :func:`identify` doesn't accept; the columns stay as they are, whatever their names.

    Rows that repeat are judged alike, those without a doc_id too.  Without any
    label in `lang` nothing is accepted and no row is left.
    """
    (found,) = free(docs.columns, "language")
    return docs.withColumn(found, classify(fitted(docs), F.col("text"))).filter(accepted(F.col(found))).drop(found)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
