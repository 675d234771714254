"""Secret scans by one combined automaton (operator 1).

All rules are compiled into a single minimal automaton (:mod:`.automaton`) that
passes over every byte once and tells rule and place; each such place is decided
by the automaton of the full rules, all places in step.  Rules are of a kind whose
first end lies within a bounded distance of their start, so texts can be scanned in
stretches.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import bytesx as bx
from .automaton import Scanner
from .names import free
from .store import small_batches

#: Understood alike by this automaton, by RE2 and by Java.
RULES = {
    "assigned_secret": r"(?i)(?:token|secret|password|passwd|api_key|apikey|access_key)[\"']? {0,2}[:=] {0,2}[\"'][A-Za-z0-9+/_.=-]{16,}",
    "aws_access_key": r"(?:AKIA|ASIA)[A-Z0-9]{16}",
    "bearer": r"(?i)bearer [A-Za-z0-9._~+/-]{24,}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{36,}",
    "google_api_key": r"AIza[A-Za-z0-9_-]{35}",
    "json_web_token": r"eyJ[A-Za-z0-9_-]{17,}",
    "private_key": r"-----BEGIN (?:(?:RSA|EC|DSA|OPENSSH) )?PRIVATE KEY-----",
    "slack_token": r"xox[abprs]-[A-Za-z0-9-]{10,}",
    "stripe_key": r"[rs]k_live_[A-Za-z0-9]{24,}",
}
NAMES = list(RULES)


@functools.cache
def scanner() -> Scanner:
    return Scanner(list(RULES.values()))


def _found(column: pa.Array, scan: Scanner) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of stretches of rows: the first row, the bytes, the rows' bounds, and (row, rule, start, end) of the matches, rows from the first on."""
    data, off = bx.buffers(column)
    for lo, hi in bx.slices(off, 4 * bx.SLICE_BYTES):
        part, at = data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        found = scan.scan(part, at)
        if len(found):
            yield lo, part, at, found


def _finder(scan_b):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, part, at, found in _found(batch.column(1), scan_b.value):
                row, rule, start, end = found.T
                chars = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])  # code points before a byte
                hashes = [hashlib.sha256(part[a:b]).hexdigest() for a, b in zip(start, end, strict=True)]
                columns = [pa.array(np.array(NAMES, dtype=object)[rule], pa.string()), pa.array(chars[start] - chars[at[row]], pa.int32()), pa.array(chars[end] - chars[start], pa.int32()), pa.array(hashes, pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), *columns], ["doc_id", "rule", "start", "length", "secret_sha256"])

    return run


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, rule, start, length, secret_sha256) of every secret; offsets in code points, from 0.

    Matches of one rule are leftmost-longest and don't overlap; those of two rules
    may.  Null and empty texts have none; a null doc_id is carried as null; rows
    that repeat give their findings again; no rows give no rows.  Texts of any
    length are scanned whole.  Other columns are not read, so their names don't
    matter.
    """
    small_batches(docs.sparkSession)
    scan_b = docs.sparkSession.sparkContext.broadcast(scanner())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_finder(scan_b), "doc_id long, rule string, start int, length int, secret_sha256 string")


def _redactor(scan_b):
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        """The text with every secret replaced by its rule's name; null where it has none."""
        for column in it:
            out: dict[int, str] = {}
            for lo, part, at, found in _found(column, scan_b.value):
                found = found[np.lexsort((-found[:, 3], found[:, 2], found[:, 0]))]
                for row, mine in zip(*_by_row(found), strict=True):
                    text = part[at[row] : at[row + 1]].tobytes()
                    done, parts = 0, []
                    for _, r, a, b in (mine - [0, 0, at[row], at[row]]).tolist():
                        if a >= done:
                            parts += [text[done:a], b"[" + NAMES[r].upper().encode() + b"]"]
                        done = max(done, b)
                    out[lo + row] = b"".join([*parts, text[done:]]).decode("utf-8", "replace")
            yield pa.array([out.get(k) for k in range(len(column))], pa.string())

    return run


def _by_row(found: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    first = np.flatnonzero(np.append(True, found[1:, 0] != found[:-1, 0]))
    return found[first, 0].tolist(), np.split(found, first[1:])


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every secret in `text` replaced, and `n_chars`, where there is one, set to the new length.

    Of overlapping secrets the first, at one place the longest, names the
    replacement of all their bytes.  Rows without a secret, null and empty texts
    among them, stay as they are, and so do rows that repeat, and all other
    columns whatever their names.  Texts of any length are scanned whole.  No rows
    give no rows.
    """
    small_batches(docs.sparkSession)
    (new,) = free(docs.columns, "redacted")
    scan_b = docs.sparkSession.sparkContext.broadcast(scanner())
    df = docs.withColumn(new, F.arrow_udf(_redactor(scan_b), "string").asNondeterministic()(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return df.withColumn("text", F.coalesce(new, "text")).drop(new)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows of `docs`, their secrets replaced; see :func:`redacted`."""
    return redacted(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    one = """SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g
    FROM documents WHERE regexp_matches(text, '{p}')"""
    rules = "\n    UNION ALL ".join(one.format(name=n, p=p.replace("'", "''")) for n, p in RULES.items())
    return f"""WITH hits AS ({rules}), places AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM hits)
SELECT doc_id, rule,
    CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS INTEGER) AS start,
    CAST(length(m[i]) AS INTEGER) AS length, sha256(m[i]) AS secret_sha256
FROM places"""


SQL = _sql()
