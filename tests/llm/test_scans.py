import textwrap
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from entloom.llm import op8_rules as rules
from entloom.llm import op9_licences as lic
from entloom.llm import op10_media as media
from entloom.llm.licences import KNOWN

from .helpers import DOC, awkward, clashing, empty, ids, prose


def duck(df, sql):
    con = duckdb.connect()
    con.register("documents", df.toArrow())
    return con.execute(sql).fetchall()


def some(spark):
    texts = [prose(1), "SHOUTING ALL DAY LONG AND NIGHT " * 5, "a$b#c% " * 60, "wow! " * 40 + "!!!!" * 20, "12 34 56 78 " * 30, "x" * 3000, "same words " * 100, "line one\n" * 30 + "other", "", "  \n", None, "é ñ ü", prose(5, 20_000)]
    return spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], DOC)


def test_rules_reject_what_they_say(spark):
    got = {r.doc_id: r.keep for r in rules.judge(some(spark)).collect()}
    assert got == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 6: False, 7: False, 8: False, 9: False, 10: False, 11: True, 12: True}


def test_rules_order_decides_nothing_and_sql_agrees(spark):
    d = some(spark).union(awkward(spark))
    names = list(rules.rules(rules.SPARK))
    a, b = rules.judge(d, names), rules.judge(d, names[::-1])
    assert ids(a, "doc_id", "keep") == ids(b, "doc_id", "keep") == sorted(duck(d, rules.SQL), key=lambda t: tuple((x is None, str(x)) for x in t))
    assert ids(rules.judge(clashing(d), names), "doc_id", "keep") == ids(a, "doc_id", "keep")
    assert rules.judge(empty(spark)).count() == 0


def test_rules_are_measured(spark):
    found = rules.measure(some(spark))
    assert {m.name for m in found} == set(rules.rules(rules.SPARK)) and all(m.cost > 0 and 0 <= m.rejects <= 1 for m in found)
    per = [(m.rejects + 1e-4) / m.cost for m in found]
    assert per == sorted(per, reverse=True)


def scanned(spark, *texts):
    df = spark.createDataFrame([(k, t, None, None, None) for k, t in enumerate(texts)], DOC)
    return {r.doc_id: r for r in lic.scan(df).collect()}


def test_entire_licences_are_found_in_any_dress(spark):
    name, isc = KNOWN[1]
    dressed = "  " + isc.upper().replace(",", " ,").replace("\n\n", "\n\nCopyright (c) 2021 Some Body\n\n").replace("LICENSE", "LICENCE")
    got = scanned(spark, isc, dressed, isc + " and more", "A text.", "Released under the MIT licence!\nmore\nlicensed under cc by nc 4.0", *[t for _, t in KNOWN])
    assert got[0].license == got[1].license == name == "ISC" and got[0].digest == got[1].digest
    assert got[2].license is None and got[3].license is None
    assert got[4].license is None and got[4].notices == "CC-BY-NC-4.0,MIT"
    assert [got[5 + k].license for k in range(len(KNOWN))] == [n for n, _ in KNOWN]


MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""


def test_long_licence_lines_are_looked_up(spark):
    flat = " ".join(MIT.split())
    padded = "//" * 200 + " Licensed under CC BY 4.0. " + " " * 400 + "#" * 300
    got = scanned(spark, f"Some text.\n{flat}\nmore", f"Some text.\n{padded}\nmore", "Some text.\n" + "licence " * 5000)
    assert len(flat) > 400 and [got[k].notices for k in range(3)] == ["MIT", "CC-BY-4.0", ""]


def test_wrapped_and_flattened_licences_are_found(spark):
    whole = [(n, t) for n, t in [*KNOWN, ("MIT", MIT)] if len(t) > 400]
    texts = [(n, textwrap.fill(t, w)) for n, t in whole for w in range(24, 100, 4)]
    texts += [(n, "Copyright (c) 2020 Some Body. " + " ".join(t.split())) for n, t in whole if t[:11] in ("Permission ", "Redistribut", "This softwa")]
    texts += [("MIT", " ".join(MIT.replace("MIT License", "MIT License\n\nCopyright (c) 2020 Some Body").split()))]
    got = scanned(spark, *[t for _, t in texts])
    assert [got[k].license for k in range(len(texts))] == [n for n, _ in texts]
    kept = ["copyright notice of it", "copyright\nholders be liable", "(c) You must retain", "copyrighted matter"]
    gone = ["Copyright 2020 X", "# Copyright (C) X", "© X", "(c) 2020 X", "Copyright Jane Doe", "Copyright: The Authors", "All rights reserved."]
    forms = [r[0] for r in spark.createDataFrame([(t,) for t in kept + gone], "t string").select(lic.canonical(F.col("t"))).collect()]
    assert forms == [lic.canonical_text(t) for t in kept + gone] and all(forms[: len(kept)]) and not any(forms[len(kept) :])


def test_complete_texts_of_common_licences_are_known(spark):
    assert scanned(spark, "The " + MIT)[0].license == "MIT"
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(p, n) for f, n in names.items() if (p := Path("/usr/share/common-licenses", f)).exists()]
    if not found:
        pytest.skip("no licence texts on this system")
    texts = [p.read_text(encoding="utf-8") for p, _ in found]
    got = scanned(spark, *texts, *[" ".join(t.split()) for t in texts])
    assert [got[k].license for k in range(len(got))] == [n for _, n in found] * 2


def test_canonical_forms_agree(spark):
    texts = ["Hello,  World!", "LICENCE\tand sub-licence", "Copyright 2020 X\nkept", "(c) me\n© you\nall rights reserved\nkept.", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(lic.canonical(F.col("t")))
    assert [r[0] for r in df.collect()] == [lic.canonical_text(t) for t in texts]


def test_licence_sql_and_awkward_rows(spark):
    d = awkward(spark).union(spark.createDataFrame([(50 + k, t, None, None, None) for k, (_, t) in enumerate(KNOWN)], DOC)).filter("doc_id <> 9")
    key = ("doc_id", "digest", "license", "notices")
    assert ids(lic.scan(d), *key) == sorted(duck(d, lic.SQL), key=lambda t: tuple((x is None, str(x)) for x in t))
    full = awkward(spark)
    assert ids(lic.scan(clashing(full)), *key) == ids(lic.scan(full), *key) and lic.scan(full).count() == full.count() and lic.scan(empty(spark)).count() == 0


def scalar_unfilter(raw):
    """One byte at a time."""
    out, above = [], [0] * (raw.rows.shape[1] - 1)
    for row in raw.rows.tolist():
        kind, line = row[0], row[1:]
        for i in range(len(line)):
            a = line[i - raw.step] if i >= raw.step else 0
            b, c = above[i], above[i - raw.step] if i >= raw.step else 0
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line[i] = (line[i] + (0, a, b, (a + b) // 2, best)[kind]) & 255
        out.append(line)
        above = line
    return np.array(out, dtype=np.uint8)


def make(colour, depth, w, h, seed, kinds=None):
    import struct
    import zlib

    rng = np.random.default_rng(seed)
    line = (w * depth * media._SAMPLES[colour] + 7) // 8
    rows = rng.integers(0, 256, (h, line + 1)).astype(np.uint8)
    rows[:, 0] = rng.integers(0, 5, h) if kinds is None else kinds
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    z = zlib.compress(rows.tobytes())
    palette = chunk(b"PLTE", rng.integers(0, 256, 48).astype(np.uint8).tobytes()) if colour == 3 else b""
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + palette + chunk(b"IDAT", z[:7]) + chunk(b"tEXt", b"x") + chunk(b"IDAT", z[7:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("colour", "depth"), [(c, d) for c, ds in media._DEPTHS.items() for d in sorted(ds)])
def test_unfilter_matches_a_scalar_version(colour, depth):
    raws = [media.inflate(make(colour, depth, 13, h, h)) for h in (1, 2, 9)] + [media.inflate(make(colour, depth, 13, 4, 7, [0, 1, 2, 1]))]
    for group in (raws, raws[-1:]):
        for raw, rows in zip(group, media.unfilter(group), strict=True):
            assert (rows == scalar_unfilter(raw)).all()
            g = media.gray(raw, rows)
            assert g.shape == (raw.height, raw.width) and 0 <= g.min() and g.max() <= 255.001
            assert isinstance(media.perceptual_hash(g), int)


def test_hash_follows_looks():
    y, x = np.mgrid[0:96, 0:128]
    rng = np.random.default_rng(5)
    waves = [rng.normal(0, 1 / (1 + i + j)) * np.cos(np.pi * i * (y + 0.5) / 96) * np.cos(np.pi * j * (x + 0.5) / 128) for i in range(9) for j in range(9)]
    image = (127 + 50 * sum(waves)).clip(0, 255)
    bits = lambda i: np.array(list(f"{media.perceptual_hash(i) & (2**64 - 1):064b}"))
    noisy = (image + np.random.default_rng(0).normal(0, 4, image.shape)).clip(0, 255)
    assert (bits(image) != bits(noisy)).sum() <= 6 and (bits(image) != bits(image[::2, ::2])).sum() <= 6
    assert (bits(image) != bits(255 - image)).sum() > 20
    assert media.perceptual_hash(np.full((3, 3), 7.0)) == 0


def test_round_trip_and_damage():
    image = np.random.default_rng(0).integers(0, 256, (37, 21)).astype(np.uint8)
    png = media.encode(image)
    assert (media.unfilter([media.inflate(png)])[0] == image).all()
    flipped = bytearray(png)
    flipped[50] ^= 1
    cases = {None: "null", b"": "no signature", png[:-20]: "cut short", bytes(flipped): "checksum", b"GIF89a" + png: "no signature", png: None}
    assert [e for *_, e in media.decode(list(cases))] == list(cases.values())


def test_media_query_rows(spark):
    rows = [(1, "u", "<html>" + "abc" * 100), (2, "u", ""), (3, None, None), (4, "u", "x"), (None, "u", "x"), (4, "u", "x"), (5, "u", "é" * 60_000)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r.page_id, r.width, r.height, r.error) for r in media.described(media.rendered(p)).collect()}
    assert got == {(1, 64, 5, None), (2, None, None, "null"), (3, None, None, "null"), (4, 64, 1, None), (None, 64, 1, None), (5, 64, 1875, None)}
    more = p.withColumn("image", F.lit("clash")).withColumn("width", F.lit(1)).withColumn("error", F.lit("e"))
    assert media.described(media.rendered(more)).count() == 7
    assert media.described(more, "page_id", "image").filter("error = 'no signature'").count() == 7
    assert media.described(media.rendered(p.limit(0))).count() == 0


def plain_hash(image):
    """Means of 32 x 32 fields by sampling, and the cosine transform by its definition."""
    h, w = image.shape
    fine = np.repeat(np.repeat(image, 32, axis=0), 32, axis=1)  # every field's edge falls between samples
    small = fine.reshape(32, h, 32, w).mean(axis=(1, 3))
    low = np.array([[sum(small[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)])
    flat = np.round(low, 6).ravel()
    bits = [b and k > 0 for k, b in enumerate(flat > np.median(flat[1:]))]
    return int("".join("01"[bool(b)] for b in bits), 2)


@pytest.mark.parametrize("shape", [(9, 5), (32, 32), (40, 70)])
def test_hash_matches_a_plain_cosine_transform(shape):
    image = np.random.default_rng(shape[0]).integers(0, 256, shape).astype(float)
    assert media.perceptual_hash(image) & (2**64 - 1) == plain_hash(image)


def interlace(image, depth=8):
    """An Adam7 PNG of an 8-bit gray picture, filters in turn, by the standard's pattern of 8 x 8 pixels."""
    import struct
    import zlib

    pattern = ["16462646", "77777777", "56565656", "77777777", "36463646", "77777777", "56565656", "77777777"]
    passes = np.array([[int(c) for c in row] for row in pattern])
    h, w = image.shape
    number = np.tile(passes, (h // 8 + 1, w // 8 + 1))[:h, :w]
    raw = b""
    for k in range(1, 8):
        rows = [image[y][number[y] == k] for y in range(h) if (number[y] == k).any()]
        above = None
        for i, row in enumerate(rows):
            kind = (0, 1, 2)[i % 3]
            left, up = np.concatenate([[0], row[:-1]]), np.zeros(len(row), int) if above is None else above
            raw += bytes([kind]) + ((row.astype(int) - (0, left, up)[kind]) & 255).astype(np.uint8).tobytes()
            above = row.astype(int)
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (8, 8), (37, 45)])
def test_interlaced_images_have_the_hash_of_plain_ones(shape):
    image = np.random.default_rng(shape[1]).integers(0, 256, shape).astype(np.uint8)
    assert media.decode([interlace(image)]) == media.decode([media.encode(image)])


def test_large_images_go_in_bands(monkeypatch):
    image = np.random.default_rng(3).integers(0, 256, (301, 70)).astype(np.uint8)
    png = media.encode(image)
    whole = media.decode([png])
    monkeypatch.setattr(media, "BAND_BYTES", 700)
    assert media.decode([png]) == whole
    wide = media.encode(np.tile(image[:2], (1, 1000)))  # a row is more than a band
    assert media.decode([wide])[0][:2] == (70_000, 2)
    assert media.decode([png[:33] + png[-12:]]) == [(None, None, None, "bad pixel data")]  # no pixel data at all


def test_an_image_beyond_the_old_limit():
    import struct
    import zlib

    w, h = 70_000, 1_000  # 2**26 pixels and more, of two stripes
    engine = zlib.compressobj(1)
    z = b"".join(engine.compress(b"\0" + bytes([255 * (y >= 500)]) * w) for y in range(h)) + engine.flush()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = media.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", z) + chunk(b"IEND", b"")
    small = np.repeat([[0.0], [255.0]], 16, axis=0).repeat(32, axis=1)
    assert media.decode([png]) == [(w, h, media.perceptual_hash(small), None)]


def test_licence_lines_of_any_length(spark):
    for line in ("Licensed under the MIT License." + " " * 600, "#" * 500 + " Licensed under the MIT License."):
        d = spark.createDataFrame([(1, f"words before\n{line}\nwords after", None, None, None)], DOC)
        assert lic.scan(d).first().notices == "MIT" and duck(d, lic.SQL)[0][3] == "MIT"
