"""Tokens, offsets and windows of text; offsets are code points, half open, from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_W = r"\p{L}\p{N}_"
_SPACE = r"\s\x{1c}-\x{1f}"
TOKEN = rf"[{_W}](?:[{_W}'\-’]*[{_W}])?|[^{_SPACE}]"
_EDGES = rf"(?U)^[{_SPACE}]+|[{_SPACE}]+$"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, _EDGES, "")


_BLOCK = 128


def spans(text: Column, pattern: str) -> Column:
    """array(struct(start, end, text)) of the matches of a pattern, from left to right.

    Offsets come from the lengths of the matches and of what is between them, so no
    Python is needed.  Running sums are taken in blocks, then over blocks: a sum over
    all matches at once copies its array with every match.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    pairs = F.transform(found, lambda m, i: F.struct(F.length(F.get(between, i)).alias("gap"), F.length(m).alias("n"), m.alias("m")))
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("all"))

    def step(a: Column, p: Column) -> Column:
        start = a["at"] + p["gap"]
        span = F.struct(start.alias("start"), (start + p["n"]).alias("end"), p["m"].alias("text"))
        return F.struct((start + p["n"]).alias("at"), F.array_append(a["all"], span).alias("all"))

    def blocks(p: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(p), F.lit(_BLOCK)), lambda lo: F.aggregate(F.slice(p, lo, _BLOCK), seed, step))

    def joined(b: Column) -> Column:
        ahead = F.aggregate(b, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x["at"]))
        shifted = lambda at: lambda s: F.struct((s["start"] + at).alias("start"), (s["end"] + at).alias("end"), s["text"].alias("text"))
        moved = F.transform(F.array(ahead), lambda a: F.transform(b, lambda x, i: F.transform(x["all"], shifted(F.get(a, i)))))
        return F.flatten(F.get(moved, F.lit(0)))

    # arrays of one, so that what is used twice is computed once
    once = F.transform(F.array(pairs), lambda p: F.when(F.size(p) > _BLOCK, F.get(F.transform(F.array(blocks(p)), joined), F.lit(0))).otherwise(F.aggregate(p, seed, step)["all"]))
    return F.get(once, F.lit(0))


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("(?U)" + TOKEN)), F.lit(0))


def context(text: Column, start: Column, end: Column, half: int) -> Column:
    """What stands up to `half` characters to either side, on one line."""
    lo = F.greatest(start - half, F.lit(0))
    piece = F.substring(text, lo + 1, F.least(end + half, F.length(text)) - lo)
    return strip(F.regexp_replace(piece, "\n", " "))
