"""Numpy kernels over the byte buffer of an Arrow string column."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SLICE_BYTES = 1 << 20
ID_BITS = 44


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift, multiply), applied to a copy."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_P, _Q = U64(0x9E3779B97F4A7C15), U64(0xF1DE83E19937733D)
_pow: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
WORD[ord("_")] = True

#: Code points that separate words: Latin-1 signs, general punctuation to mathematical signs, those of Chinese and Japanese, byte order mark, full-width signs.
BETWEEN = ((0x80, 0xA9), (0xAB, 0xB4), (0xB6, 0xB9), (0xBB, 0xBF), (0xD7, 0xD7), (0xF7, 0xF7), (0x2000, 0x23FF), (0x2500, 0x2BFF), (0x3000, 0x3004), (0x3008, 0x3020), (0xFE30, 0xFE4F), (0xFEFF, 0xFEFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))
#: Code points of scripts written without blanks, each a word of its own: Thai and Lao, Myanmar, Khmer, kana, Chinese.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3021, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x323AF))
_EDGES, _KINDS = zip(*sorted([(lo, kind) for spans, kind in ((BETWEEN, 1), (ALONE, 2)) for lo, _ in spans] + [(hi + 1, 0) for spans in (BETWEEN, ALONE) for _, hi in spans if all(hi + 1 != lo for s in (BETWEEN, ALONE) for lo, _ in s)]), strict=True)
_EDGES, _KINDS = np.array((0, *_EDGES)), np.array((0, *_KINDS), dtype=np.int8)


def strings(column: pa.Array) -> pa.Array:
    """As an array of int64-offset strings, nulls kept."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes, and n+1 offsets into them. A null has no bytes."""
    column = strings(column)
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    off = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each; one long row is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = int(np.searchsorted(off, off[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + (1 << 19))
        yield lo, hi
        lo = hi


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**j and P**-j modulo 2**64, j < n."""
    if not _pow or len(_pow[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        inverse = U64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            up, down = np.full(m, _P), np.full(m, inverse)
            up[0] = down[0] = 1
            _pow[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _pow[0], _pow[1]


def lower(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and of the Latin-1 letters in UTF-8."""
    out = LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    if len(at):
        second = out[at]
        out[at] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 32, second)
    return out


def _beyond_ascii(data: np.ndarray, inside: np.ndarray, edge: np.ndarray) -> None:
    """Takes separators out of `inside`, and sets `edge` where a character that is a word of its own begins and ends."""
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return
    first = data[lead].astype(np.int64)
    size = np.where(first >= 0xF0, 4, np.where(first >= 0xE0, 3, 2))
    code = first & np.where(size == 2, 0x1F, np.where(size == 3, 0x0F, 0x07))
    last = len(data) - 1
    for k in range(1, 4):
        code = np.where(size > k, (code << 6) | (data[np.minimum(lead + k, last)] & 0x3F), code)
    kind = _KINDS[np.searchsorted(_EDGES, code, side="right") - 1]
    between, wide = lead[kind == 1], size[kind == 1]
    for k in range(4):
        inside[np.minimum(between[wide > k] + k, last)] = False
    alone, wide = lead[kind == 2], size[kind == 2]
    edge[alone] = True
    after = alone + wide
    edge[after[after <= last]] = True


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of every word.

    A word is a run of letters, digits, _ and other characters beyond ASCII that
    aren't in BETWEEN; a character in ALONE is a word of its own.
    """
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside = WORD[data]
    edge = np.zeros(len(data), dtype=bool)
    edge[off[:-1][off[:-1] < len(data)]] = True
    _beyond_ascii(data, inside, edge)
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the lower-cased bytes of every word."""
    with np.errstate(over="ignore"):
        up, down = powers(len(data) + 1)
        total = np.empty(len(data) + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_BYTE[lower(data)] * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start])


def shingles(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct word n-grams: document, 44-bit id, times; sorted by document and id.

    A document of fewer words than n has one shingle of all its words; one
    without words has none.
    """
    start, end, doc = words(data, off)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = word_hashes(data, start, end)
        last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
        first = np.append(0, last[:-1] + 1)
        left = np.repeat(last, last - first + 1) - np.arange(len(doc))
        head = np.zeros(len(doc), dtype=bool)
        head[first] = True
        x = h * (_Q | U64(1))
        for k in range(1, n):
            nxt = np.zeros_like(h)
            nxt[: len(h) - k] = h[k:]
            nxt[left < k] = U64(k)
            x = mix(x + nxt * (_P * U64(2 * k + 1)))
        use = (left >= n - 1) | head
        key = (doc[use].astype(np.uint64) << U64(ID_BITS)) | (mix(x[use]) >> U64(64 - ID_BITS))
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    times = np.diff(np.append(new, len(key)))
    key = key[new]
    return (key >> U64(ID_BITS)).astype(np.int64), key & U64((1 << ID_BITS) - 1), times
