"""Mixing sources to target weights by entropy balancing (operator 7).

Tokens of document i have the base share q_i.  Wanted are shares p with exactly the
target share of every source and, as nearly as that allows, the corpus's own mean of
ln(tokens) (so that moving weight between sources doesn't trade short documents for
long ones), nearest to q in relative entropy: p_i = q_i exp(l_source + v z_i), where
z is ln(tokens) in standard units.  The dual

    D(l, v) = sum q_i exp(l_source + v z_i) - sum target_s l_s + RIDGE / 2 v**2

is strictly convex and has a minimum for any targets, since the penalty leaves the
second moment off by RIDGE * v where it can't be met; Newton's method finds it.  Every iteration is one distributed
aggregation by source over the table of (source, tokens, documents); the driver
sees three sums of each source.  A document's rate is epochs * exp(l + v z), and
its copies are the rate rounded up or down by a hash of its doc_id, right on
average.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from . import tokens as tk
from .names import free
from .store import Store

#: Targets are the source shares to this power, where none are given.
TEMPERATURE = 0.5
EPOCHS = 1.0
#: How softly the mean of ln(tokens) is held; without it, sources of other lengths could have no solution.
RIDGE = 0.25
MOST_ROUNDS = 40
MOST_HALVINGS = 50
TOLERANCE = 1e-12


@dataclass
class Mix:
    tilt: dict[str, float]  # l of each source; a source without one has rate 0
    slope: float
    mean: float
    spread: float
    target: dict[str, float]
    rounds: int
    error: float


def _source(df: DataFrame) -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in df.columns else F.lit("")


def _z(mix: Mix, tokens: Column) -> Column:
    return (F.log(F.greatest(tokens, F.lit(1)).cast("double")) - F.lit(mix.mean)) / F.lit(mix.spread)


def _tilt(mix: Mix, source: Column) -> Column:
    pairs = [F.lit(x) for kv in mix.tilt.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), source) if pairs else F.lit(None).cast("double")


def solve(counted: DataFrame, target: dict[str, float] | None = None) -> Mix:
    """The dual's solution for a table (source, tokens, n) of documents that have tokens.

    Targets are normalised over the sources that exist; sources left out of
    `target`, or given 0, get no tilt and so no copies.
    """
    total = counted.groupBy("source").agg(
        F.sum(F.col("n") * F.col("tokens")).alias("t"),
        F.sum(F.col("n") * F.col("tokens") * F.log(F.col("tokens").cast("double"))).alias("a"),
        F.sum(F.col("n") * F.col("tokens") * F.log(F.col("tokens").cast("double")) ** 2).alias("b"),
    ).collect()
    have = {r.source: float(r.t) for r in sorted(total, key=lambda r: r.source)}
    whole = sum(have.values())
    if not whole:
        return Mix({}, 0.0, 0.0, 1.0, {}, 0, 0.0)
    mean = sum(r.a for r in total) / whole
    spread = math.sqrt(max(sum(r.b for r in total) / whole - mean**2, 0.0))
    raw = {s: (t / whole) ** TEMPERATURE for s, t in have.items()} if target is None else {s: float(w) for s, w in target.items() if s in have and w > 0}
    goal = {s: w / sum(raw.values()) for s, w in raw.items()}
    mix = Mix({s: math.log(goal[s] * whole / have[s]) for s in goal}, 0.0, mean, spread if spread > 1e-9 else 1.0, goal, 0, 0.0)
    if spread <= 1e-9 or not goal:
        return mix

    def sums(m: Mix) -> dict[str, tuple[float, float, float]]:
        z = _z(m, F.col("tokens"))
        mass = F.col("n") * F.col("tokens") / F.lit(whole) * F.exp(_tilt(m, F.col("source")) + F.lit(m.slope) * z)
        rows = counted.groupBy("source").agg(F.sum(mass).alias("p"), F.sum(mass * z).alias("pz"), F.sum(mass * z * z).alias("pzz")).collect()
        return {r.source: (r.p, r.pz, r.pzz) for r in rows if r.source in goal}

    def dual(m: Mix, s: dict) -> float:
        return sum(p for p, _, _ in s.values()) - sum(goal[k] * m.tilt[k] for k in goal) + RIDGE / 2 * m.slope**2

    def error(m: Mix, s: dict) -> float:
        return max(abs(sum(v[1] for v in s.values()) + RIDGE * m.slope), *(abs(s[k][0] - goal[k]) for k in goal))

    now = sums(mix)
    for k in range(1, MOST_ROUNDS + 1):
        if error(mix, now) < TOLERANCE:
            break
        gradient = {s: now[s][0] - goal[s] for s in goal}
        slope_gradient = sum(v[1] for v in now.values()) + RIDGE * mix.slope
        # the Hessian is an arrow: a diagonal over the sources, and one row for the slope
        schur = RIDGE + sum(v[2] - v[1] ** 2 / v[0] for v in now.values())
        step_slope = -(slope_gradient - sum(now[s][1] * gradient[s] / now[s][0] for s in goal)) / schur
        step = {s: -(gradient[s] + now[s][1] * step_slope) / now[s][0] for s in goal}
        size, before = 1.0, dual(mix, now)
        for _ in range(MOST_HALVINGS):
            trial = Mix({s: mix.tilt[s] + size * step[s] for s in goal}, mix.slope + size * step_slope, mean, mix.spread, goal, k, 0.0)
            after = sums(trial)
            if dual(trial, after) <= before + 1e-12:
                break
            size /= 2
        else:
            raise RuntimeError(f"the dual doesn't fall along Newton's step of round {k}: {before}")
        mix, now = trial, after
    mix.error = error(mix, now)
    return mix


def rate(mix: Mix, source: Column, tokens: Column, epochs: float = EPOCHS) -> Column:
    found = F.lit(epochs) * F.exp(_tilt(mix, source) + F.lit(mix.slope) * _z(mix, tokens))
    return F.when(tokens > 0, F.coalesce(found, F.lit(0.0))).otherwise(0.0)


def copies(rate_: Column, doc_id: Column) -> Column:
    """The rate rounded up or down, by a uniform number that is the doc_id's own: the first 32 bits of its MD5 sum."""
    uniform = F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    return F.floor(rate_ + uniform).cast("int")


def counted_tokens(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source(docs).alias("source"), tk.counted_once(F.col("text")).alias("tokens"))


def _solved(counts: DataFrame, store: Store, target: dict[str, float] | None) -> Mix:
    table = store.keep(counts.filter("tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")), "lengths")
    return solve(table, target)


def mixed(docs: DataFrame, target: dict[str, float] | None = None, epochs: float = EPOCHS) -> DataFrame:
    """(doc_id, source, tokens, rate, copies) of every row of `docs`.

    A null source, or no such column, is the source ''.  A document without tokens
    (null or empty text) has rate 0.  Rows that repeat are documents of their own
    and round alike; so do null doc_ids.  Tokens of texts of any length are all
    counted.  No rows give no rows.  Other columns are not read, so their names
    don't matter.
    """
    store = Store(docs.sparkSession, "mixing")
    counts = store.keep(counted_tokens(docs), "tokens")
    mix = _solved(counts, store, target)
    found = counts.withColumn("rate", rate(mix, F.col("source"), F.col("tokens"), epochs))
    return found.select("doc_id", "source", "tokens", F.round("rate", 6).alias("rate"), copies(F.round("rate", 6), F.col("doc_id")).alias("copies"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """`docs` with every row as often as its copies say; the columns stay as they are, whatever their names.

    Rows without tokens have no copy.  Tokens are counted once, into a table of the
    rows and their counts that both the balancing and the copying read.
    """
    store = Store(spark, "mixing-stage")
    tokens, k = free(docs.columns, "tokens", "k")
    rows = store.keep(docs.withColumn(tokens, tk.count(F.col("text"))), "rows")
    table = rows.select(_source(rows).alias("source"), F.col(tokens).alias("tokens"))
    mix = _solved(table, store, None)
    times = copies(F.round(rate(mix, _source(docs), F.col(tokens)), 6), F.col("doc_id"))
    return rows.withColumn(k, F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).drop(tokens, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql(rounds: int = 12) -> str:
    """The same rates in SQL: given the slope, every source's tilt is known, so Newton's method on the slope alone, unrolled."""
    piece = tk.PIECE.replace("\\t", "\t").replace("\\r", "\r").replace("\\n", "\n")
    steps = "".join(f""",
s{k} AS (SELECT goal, sum(w * exp(v{k - 1}.v * z)) AS p, sum(w * exp(v{k - 1}.v * z) * z) AS pz, sum(w * exp(v{k - 1}.v * z) * z * z) AS pzz FROM lengths, v{k - 1} GROUP BY source, goal),
v{k} AS (SELECT v - (SELECT sum(goal * pz / p) + {RIDGE} * v FROM s{k}) / (SELECT sum(goal * (pzz / p - pz / p * pz / p)) + {RIDGE} FROM s{k}) AS v FROM v{k - 1})""" for k in range(1, rounds + 1))
    return f"""WITH counted AS (SELECT doc_id, coalesce(source, '') AS source, CAST(coalesce(len(regexp_extract_all(text, '{piece}')), 0) AS BIGINT) AS tokens FROM documents),
have AS (SELECT source, CAST(sum(tokens) AS DOUBLE) AS t FROM counted WHERE tokens > 0 GROUP BY source),
goals AS (SELECT source, t, sqrt(t) / (SELECT sum(sqrt(t)) FROM have) AS goal FROM have),
units AS (SELECT (SELECT sum(t) FROM have) AS whole, sum(tokens * ln(tokens)) / sum(tokens) AS mean, sum(tokens * ln(tokens) * ln(tokens)) / sum(tokens) AS square FROM counted WHERE tokens > 0),
lengths AS (SELECT source, goal, CAST(tokens AS DOUBLE) * count(*) / any_value(whole) AS w, (ln(tokens) - any_value(mean)) / sqrt(any_value(square) - any_value(mean) * any_value(mean)) AS z
    FROM counted JOIN goals USING (source), units WHERE tokens > 0 GROUP BY source, goal, tokens),
v0 AS (SELECT CAST(0 AS DOUBLE) AS v){steps},
tilts AS (SELECT source, any_value(v) AS v, any_value(goal) / sum(w * exp(v * z)) AS tilt FROM lengths, v{rounds} GROUP BY source),
rated AS (SELECT doc_id, c.source, tokens, round(CASE WHEN tokens > 0 THEN tilt * exp(v * (ln(tokens) - mean) / sqrt(square - mean * mean)) ELSE 0 END, 6) AS rate FROM counted c LEFT JOIN tilts USING (source), units)
SELECT doc_id, source, tokens, rate, CAST(floor(rate + CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296) AS INTEGER) AS copies FROM rated"""


#: For the default temperature of one half and one epoch.
SQL = _sql()
