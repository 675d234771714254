"""Tokens of Arrow string columns by numpy, many texts at a time; the same tokens as the pattern in :mod:`.text`.

Some 70 bytes of numpy arrays go with each byte of text, so batches are taken in
:func:`pieces`, whatever number of texts and bytes a batch has.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE, _WORD, _INNER = 1, 2, 4

#: Bytes of text that are taken at once.
PIECE = 1 << 20


def pieces(column: pa.Array) -> Iterator[slice]:
    """The rows of a column, cut into runs of PIECE bytes at most, or of one longer text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo, done = 0, 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, done + PIECE, side="right")))
        yield slice(lo, hi)
        lo, done = hi, ends[hi - 1]


@functools.cache
def _kinds() -> np.ndarray:
    """Of every code point: white space, what a word is made of, and what may stand inside one."""
    kinds = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isspace():
            kinds[c] = _SPACE
        elif s == "_" or unicodedata.category(s)[0] in "LN":
            kinds[c] = _WORD | _INNER
    kinds[[ord(c) for c in "'-’"]] = _INNER
    return kinds


@dataclass
class Tokens:
    """Places count code points of the whole batch, texts apart by one blank each; `first` has the place of each text's first, and one more."""

    kinds: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    raw: bytes
    at_byte: np.ndarray  # of each place, and one more

    def text(self, lo: int, hi: int) -> str:
        return self.raw[self.at_byte[lo] : self.at_byte[hi]].decode("utf-8")

    def texts(self, lo: np.ndarray, hi: np.ndarray) -> pa.Array:
        return pa.array([self.raw[a:b] for a, b in zip(self.at_byte[lo].tolist(), self.at_byte[hi].tolist(), strict=True)], pa.binary()).cast(pa.string())


def tokenize(column: pa.Array) -> Tokens:
    """Tokens of all texts of a column; a null has none."""
    texts = [t or "" for t in column.to_pylist()]
    joined = "".join(f"{t} " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate([[0], np.cumsum(size + 1)])
    kinds = _kinds()[points]
    word, inner = (kinds & _WORD) > 0, (kinds & _INNER) > 0
    run = np.flatnonzero(np.diff(inner.astype(np.int8), prepend=0) == 1)
    stop = np.flatnonzero(np.diff(inner.astype(np.int8), append=0) == -1) + 1
    words = np.flatnonzero(word)
    a, b = np.searchsorted(words, run), np.searchsorted(words, stop)
    some = b > a  # a run of what may stand inside a word, from its first letter to its last
    lo, hi = words[a[some]], words[b[some] - 1] + 1
    covered = np.zeros(len(points) + 1, dtype=np.int32)
    np.add.at(covered, lo, 1)
    np.add.at(covered, hi, -1)
    single = np.flatnonzero((np.cumsum(covered)[:-1] == 0) & ((kinds & _SPACE) == 0))
    start, end = np.concatenate([lo, single]), np.concatenate([hi, single + 1])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    return Tokens(kinds, first, start, end, np.searchsorted(first, start, side="right") - 1, joined.encode("utf-8"), np.concatenate([[0], np.cumsum(width)]))


def offsets(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Of a piece: row, start, end and text of every token; places from the start of its own text."""
    t = tokenize(column)
    base = t.first[t.row]
    return t.row, t.start - base, t.end - base, t.texts(t.start, t.end)


def grams(column: pa.Array, sizes: list[int], openers: pa.Array | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """As :func:`offsets`, of every stretch of so many tokens; with `openers`, only of those whose first token is one of them."""
    t = tokenize(column)
    use = np.arange(len(t.start))
    if openers is not None:
        use = np.flatnonzero(pc.is_in(t.texts(t.start, t.end), value_set=openers).to_numpy(zero_copy_only=False))
    i = np.concatenate([use[use + n <= len(t.start)] for n in sizes]) if sizes else np.zeros(0, np.int64)
    j = np.concatenate([use[use + n <= len(t.start)] + n - 1 for n in sizes]) if sizes else np.zeros(0, np.int64)
    own = t.row[i] == t.row[j]
    i, j = i[own], j[own]
    base = t.first[t.row[i]]
    return t.row[i], t.start[i] - base, t.end[j] - base, t.texts(t.start[i], t.end[j])


def snapped(column: pa.Array, starts: pa.ListArray, ends: pa.ListArray) -> pa.Array:
    """list(struct(start, end, text)): each span of each text widened to the tokens that its ends cut, then trimmed of white space."""
    parts = [_snapped(column[k], starts[k], ends[k]) for k in pieces(column)]
    return pa.concat_arrays(parts) if parts else _snapped(column, starts, ends)


def _snapped(column: pa.Array, starts: pa.ListArray, ends: pa.ListArray) -> pa.Array:
    t = tokenize(column)
    counts = np.array([0 if n is None else n for n in pc.list_value_length(starts).to_pylist()], dtype=np.int64)
    row = np.repeat(np.arange(len(column)), counts)
    s, e = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, ends))
    base, size = t.first[row], np.diff(t.first)[row] - 1
    valid = (s >= 0) & (e > s) & (e <= size)
    lo, hi = np.where(valid, base + s, 0), np.where(valid, base + e, 0)

    def inside(at: np.ndarray, edge: np.ndarray) -> np.ndarray:
        if not len(t.start):
            return at
        k = np.maximum(np.searchsorted(t.start, at, side="left") - 1, 0)
        return np.where((t.start[k] < at) & (at < t.end[k]), edge[k], at)

    lo, hi = inside(lo, t.start), inside(hi, t.end)
    ink = np.flatnonzero((t.kinds & _SPACE) == 0)
    near = np.append(ink, len(t.kinds))[np.searchsorted(ink, lo)]
    far = np.concatenate([[-1], ink])[np.searchsorted(ink, hi)] + 1
    lo = np.minimum(near, hi)
    hi = np.maximum(far, lo)
    new_s, new_e = np.where(valid, lo - base, s), np.where(valid, hi - base, e)
    shown = np.where((new_s >= 0) & (new_e > new_s), np.minimum(new_s, size), 0), np.where((new_s >= 0) & (new_e > new_s), np.minimum(new_e, size), 0)
    text = t.texts(base + shown[0], base + np.maximum(shown[1], shown[0]))
    values = pa.StructArray.from_arrays([pa.array(new_s, pa.int32()), pa.array(new_e, pa.int32()), text], ["start", "end", "text"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)
