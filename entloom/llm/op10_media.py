"""Media columns: PNG images in binary columns (operator 10).

Decoding takes the chunks apart, tests every checksum, inflates the pixel data
with zlib and undoes the row filters with numpy.  Filters depend on the pixels to
the left, above and above left, so a batch of images is undone along its
anti-diagonals, all images and rows of one diagonal at once, whatever mix of the
five filters the rows use.  A perceptual hash is the sign of the low-frequency
cosine-transform coefficients against their median.

The transform reads a small picture of means, which is a sum over pixels, so large
images are inflated and undone in bands of rows and never held; the passes of an
interlaced image are added up in the same way.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import bytesx as bx
from .names import free
from .store import small_batches

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples of a pixel, by colour type.
_SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
_DEPTHS = {0: {1, 2, 4, 8, 16}, 2: {8, 16}, 3: {1, 2, 4, 8}, 4: {8, 16}, 6: {8, 16}}
HASH_SIDE, HASH_LOW = 32, 8
#: Bytes of filtered rows that are held at once: larger images go in bands. No image is too large.
BAND_BYTES = 1 << 22
#: Of an interlaced image: first column and row, and their steps, of each pass.
_ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


@dataclass
class Header:
    width: int
    height: int
    depth: int
    colour: int
    interlaced: bool
    palette: np.ndarray | None
    data: list[bytes]  # contents of the IDAT chunks

    @property
    def step(self) -> int:
        """Bytes of a pixel, 1 at least."""
        return max(1, self.depth * _SAMPLES[self.colour] // 8)

    def line(self, width: int) -> int:
        """Bytes of a filtered row."""
        return 1 + (width * self.depth * _SAMPLES[self.colour] + 7) // 8


@dataclass
class Raw:
    """Rows of an image, of a band or of an interlacing pass."""

    header: Header
    width: int
    rows: np.ndarray  # height x (1 + bytes of a row): filter type and filtered bytes

    @property
    def step(self) -> int:
        return self.header.step

    @property
    def height(self) -> int:
        return len(self.rows)


def chunks(png: bytes) -> list[tuple[bytes, bytes]]:
    """Types and contents of the chunks up to IEND; ValueError on a wrong signature, length or checksum."""
    if png[:8] != SIGNATURE:
        raise ValueError("no signature")
    found, at = [], 8
    while True:
        if at + 12 > len(png):
            raise ValueError("cut short")
        size = int.from_bytes(png[at : at + 4], "big")
        if at + 12 + size > len(png):
            raise ValueError("cut short")
        kind, body = png[at + 4 : at + 8], png[at + 8 : at + 8 + size]
        if zlib.crc32(body, zlib.crc32(kind)) != int.from_bytes(png[at + 8 + size : at + 12 + size], "big"):
            raise ValueError("checksum")
        found.append((kind, body))
        at += 12 + size
        if kind == b"IEND":
            return found


def header(png: bytes) -> Header:
    """What a PNG says of itself, all checksums tested; ValueError says what is wrong."""
    found = chunks(png)
    if found[0][0] != b"IHDR" or len(found[0][1]) != 13:
        raise ValueError("no header")
    width, height, depth, colour, compression, filters, interlace = struct.unpack(">IIBBBBB", found[0][1])
    if not 0 < width < 1 << 31 or not 0 < height < 1 << 31 or depth not in _DEPTHS.get(colour, ()) or compression or filters or interlace > 1:
        raise ValueError("bad header")
    palette = next((np.frombuffer(b, np.uint8).reshape(-1, 3) for k, b in found if k == b"PLTE" and b and len(b) % 3 == 0), None)
    if colour == 3 and palette is None:
        raise ValueError("no palette")
    return Header(width, height, depth, colour, bool(interlace), palette, [b for k, b in found if k == b"IDAT"])


class _Inflater:
    """Rows of pixel data, as many at a time as are asked for."""

    def __init__(self, head: Header):
        self.engine, self.parts, self.left = zlib.decompressobj(), iter(head.data), b""

    def take(self, size: int) -> bytes:
        out = []
        while size > 0 and not self.engine.eof:
            if not self.left:
                self.left = next(self.parts, b"")
                if not self.left:
                    break
            try:
                out.append(self.engine.decompress(self.left, size))
            except zlib.error as e:
                raise ValueError("bad pixel data") from e
            self.left = self.engine.unconsumed_tail
            size -= len(out[-1])
        return b"".join(out)

    def rows(self, n: int, line: int) -> np.ndarray:
        data = self.take(n * line)
        if len(data) != n * line:
            raise ValueError("bad pixel data")
        rows = np.frombuffer(data, dtype=np.uint8).reshape(n, line)
        if n and rows[:, 0].max() > 4:
            raise ValueError("bad filter")
        return rows

    def end(self) -> None:
        if self.take(1) or not self.engine.eof:
            raise ValueError("bad pixel data")


def inflate(png: bytes, head: Header | None = None) -> Raw:
    """All filtered rows of an image that isn't interlaced."""
    head = head or header(png)
    engine = _Inflater(head)
    rows = engine.rows(head.height, head.line(head.width))
    engine.end()
    return Raw(head, head.width, rows)


def unfilter(images: list[Raw], above: np.ndarray | None = None) -> list[np.ndarray]:
    """Bytes of the rows of images that share bytes of a row and of a pixel; shorter ones are filled up with rows of zeros.

    `above` has the bytes of the row above a single image's first; zeros if None.
    """
    line, step = images[0].rows.shape[1] - 1, images[0].step
    n, height = len(images), max(r.height for r in images)
    width = line // step
    kinds = np.zeros((height, n), dtype=np.uint8)
    x = np.zeros((height + 1, width + 1, n, step), dtype=np.int16)  # a row above and a pixel to the left are zeros
    if above is not None:
        x[0, 1:, 0] = above.reshape(width, step)
    for k, r in enumerate(images):
        kinds[: r.height, k] = r.rows[:, 0]
        x[1 : r.height + 1, 1:, k] = r.rows[:, 1:].reshape(r.height, width, step)
    simple = not np.isin(kinds, (3, 4)).any()
    if simple:
        for row in range(1, height + 1):
            kind = kinds[row - 1]
            sub = np.cumsum(x[row], axis=0, dtype=np.int64)
            x[row] = np.where((kind == 1)[None, :, None], sub & 255, np.where((kind == 2)[None, :, None], (x[row] + x[row - 1]) & 255, x[row]))
    else:
        for diagonal in range(2, height + width + 1):
            r = np.arange(max(1, diagonal - width), min(height, diagonal - 1) + 1)
            c = diagonal - r
            a, b, d = x[r, c - 1], x[r - 1, c], x[r - 1, c - 1]
            kind = kinds[r - 1][:, :, None]
            pa_, pb, pc = np.abs(b - d), np.abs(a - d), np.abs(a + b - 2 * d)
            paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, d))
            guess = np.choose(kind, [np.int16(0), a, b, (a + b) >> 1, paeth])
            x[r, c] = (x[r, c] + guess) & 255
    return [x[1 : r.height + 1, 1:, k].reshape(r.height, line).astype(np.uint8) for k, r in enumerate(images)]


def gray(raw: Raw, rows: np.ndarray) -> np.ndarray:
    """Brightness from 0 to 255 of every pixel."""
    head, width, height = raw.header, raw.width, raw.height
    samples = _SAMPLES[head.colour]
    if head.depth == 16:
        v = rows.reshape(height, width, samples, 2)[..., 0].astype(np.float64)
    elif head.depth == 8:
        v = rows.reshape(height, width, samples).astype(np.float64)
    else:
        bits = np.unpackbits(rows, axis=1)[:, : width * head.depth].reshape(height, width, head.depth)
        v = (bits @ (1 << np.arange(head.depth)[::-1]))[..., None].astype(np.float64)
        if head.colour == 0:
            v *= 255 / ((1 << head.depth) - 1)
    if head.colour == 3:
        v = head.palette[np.minimum(v[..., 0].astype(int), len(head.palette) - 1)].astype(np.float64)
    return v[..., :3] @ np.array([0.299, 0.587, 0.114]) if v.shape[-1] >= 3 else v[..., 0]


def _reduce(n: int, at: np.ndarray) -> np.ndarray:
    """Matrix from the pixels `at` of n to the means of HASH_SIDE equal stretches of all."""
    edge = np.arange(HASH_SIDE + 1) * n / HASH_SIDE
    lo, hi = edge[:-1, None], edge[1:, None]
    return np.clip(np.minimum(hi, at + 1) - np.maximum(lo, at), 0, None) / (n / HASH_SIDE)


def _means(head: Header, image: np.ndarray, ys: np.ndarray, x0: int, dx: int) -> np.ndarray:
    """What rows `ys`, of columns from x0 in steps, add to the small picture."""
    small = np.zeros((len(image), HASH_SIDE))
    for lo in range(0, image.shape[1], 1 << 15):
        part = image[:, lo : lo + (1 << 15)]
        small += part @ _reduce(head.width, x0 + dx * np.arange(lo, lo + part.shape[1])).T
    return _reduce(head.height, ys) @ small


def in_bands(head: Header) -> np.ndarray:
    """The small picture of an image of any size, interlaced or not, holding BAND_BYTES or one row at a time."""
    engine, small = _Inflater(head), np.zeros((HASH_SIDE, HASH_SIDE))
    for x0, y0, dx, dy in _ADAM7 if head.interlaced else ((0, 0, 1, 1),):
        width, height = max(0, -(-(head.width - x0) // dx)), max(0, -(-(head.height - y0) // dy))
        if not width or not height:
            continue
        line = head.line(width)
        most, above = max(1, BAND_BYTES // line), None
        for lo in range(0, height, most):
            raw = Raw(head, width, engine.rows(min(most, height - lo), line))
            rows = unfilter([raw], above)[0]
            above = rows[-1]
            small += _means(head, gray(raw, rows), y0 + dy * np.arange(lo, lo + len(rows)), x0, dx)
    engine.end()
    return small


_COS = np.cos(np.pi * (2 * np.arange(HASH_SIDE) + 1) * np.arange(HASH_LOW)[:, None] / (2 * HASH_SIDE))


def perceptual_hash(image: np.ndarray) -> int:
    """64 bits as a signed integer: which low-frequency coefficients exceed their median; the constant one is left out of it."""
    return _hash(_reduce(image.shape[0], np.arange(image.shape[0])) @ image @ _reduce(image.shape[1], np.arange(image.shape[1])).T)


def _hash(small: np.ndarray) -> int:
    low = np.round(_COS @ small @ _COS.T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return int(np.packbits(bits).view(">i8")[0])


def decode(pngs: list[bytes | None]) -> list[tuple[int | None, int | None, int | None, str | None]]:
    """(width, height, hash, error) of each image. Small images of the same row length are undone together."""
    out: list = [(None, None, None, "null")] * len(pngs)
    groups: dict[tuple[int, int], list[tuple[int, Raw]]] = {}
    for k, png in enumerate(pngs):
        if png is None:
            continue
        try:
            head = header(png)
            if head.interlaced or head.line(head.width) * head.height > BAND_BYTES:
                out[k] = (head.width, head.height, _hash(in_bands(head)), None)
                continue
            raw = inflate(png, head)
        except ValueError as e:
            out[k] = (None, None, None, str(e))
        else:
            groups.setdefault((raw.rows.shape[1], head.step), []).append((k, raw))
    for found in groups.values():
        found.sort(key=lambda f: f[1].height)
        lo = 0
        while lo < len(found):
            hi = lo + 1
            while hi < len(found) and hi - lo < 256 and found[hi][1].rows.size * (hi + 1 - lo) < 1 << 20 and found[hi][1].height <= 1.25 * found[lo][1].height + 8:
                hi += 1
            for (k, raw), rows in zip(found[lo:hi], unfilter([r for _, r in found[lo:hi]]), strict=True):
                out[k] = (raw.width, raw.height, _hash(_means(raw.header, gray(raw, rows), np.arange(raw.height), 0, 1)), None)
            lo = hi
    return out


def encode(image: np.ndarray, filters: np.ndarray | None = None) -> bytes:
    """An 8-bit gray PNG; `filters` has the filter of each row (all five in turn by default)."""
    h, w = image.shape
    kinds = np.arange(h) % 5 if filters is None else filters
    x = np.zeros((h + 1, w + 1), dtype=np.int16)
    x[1:, 1:] = image
    a, b, c = x[1:, :-1], x[:-1, 1:], x[:-1, :-1]
    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    paeth = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
    guess = np.choose(kinds[:, None], [np.zeros_like(a), a, b, (a + b) >> 1, paeth])
    rows = np.concatenate([kinds[:, None], (x[1:, 1:] - guess) & 255], axis=1).astype(np.uint8)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))

    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


RENDER_WIDTH = 64


def _render(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for column in it:
        data, off = bx.buffers(column)
        out = []
        for k in range(len(column)):
            raw = data[off[k] : off[k + 1]]
            if not len(raw):
                out.append(None)
                continue
            image = np.zeros(-(-len(raw) // RENDER_WIDTH) * RENDER_WIDTH, dtype=np.uint8)
            image[: len(raw)] = raw
            out.append(encode(image.reshape(-1, RENDER_WIDTH)))
        yield pa.array(out, pa.binary())


def rendered(pages: DataFrame) -> DataFrame:
    """(page_id, image): the bytes of a page's whole HTML as a gray PNG, RENDER_WIDTH pixels wide.

    The tables hold no images; this gives every page one.  Null and empty HTML has a
    null image; very long HTML makes a tall image, none of it is cut.
    """
    small_batches(pages.sparkSession)
    return pages.select("page_id", F.arrow_udf(_render, "binary")(F.col("html").cast("string")).alias("image"))


def described(images: DataFrame, key: str = "page_id", column: str = "image") -> DataFrame:
    """(key, width, height, phash, error) of every row with a PNG in a binary column.

    `error` is null for an image that decodes; otherwise it says what is wrong
    ("null" for a null) and the others are null.  An empty value has no signature.
    Images of any size are decoded, large and interlaced ones in bands of rows.
    Rows that repeat, and null keys, are carried as they are; images that look alike
    may share a hash.  No rows give no rows.  Other columns are not read, so their
    names don't matter.
    """
    small_batches(images.sparkSession)

    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for binary in it:
            found = decode(binary.to_pylist())
            columns = list(zip(*found, strict=True)) if found else [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.string())
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["width", "height", "phash", "error"])

    # not deterministic for the planner only, which would otherwise decode once for each field
    seen = F.arrow_udf(run, "width int, height int, phash long, error string").asNondeterministic()(F.col(column).cast("binary"))
    (name,) = free([key], "seen")
    return images.select(F.col(key), seen.alias(name)).select(key, f"{name}.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(rendered(spread(spark.read.parquet(f"{sf_dir}/pages.parquet"))))
