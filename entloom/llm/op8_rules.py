"""Quality rules as a short-circuit cascade (operator 8).

Each rule is a SQL condition for a document to stay.  On a sample their cost
(seconds) and selectivity (share rejected) are measured, and the rules are put in
order of rejection per cost.  The order decides only how much work is done: a
document stays if it passes all rules.  The cascade is one CASE expression, which
Spark evaluates branch by branch, so that a rejected document costs nothing more.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from .store import Store

#: Documents of the sample that orders the rules (by the hash of doc_id); it has no influence on the result.
SAMPLE_ROWS = 600


@dataclass(frozen=True)
class Dialect:
    """How an engine says what the rules need.

    Spark counts matches and never builds a string or a list that it only measures;
    DuckDB's forms are others on purpose.
    """

    name: str

    def _p(self, pattern: str) -> str:
        return pattern.replace("\\", "\\\\") if self.name == "spark" else pattern

    def chars(self, kept: str) -> str:
        """Characters of a class."""
        if self.name == "spark":
            return f"regexp_count(text, '{self._p(f'[{kept}]')}')"
        return f"length(regexp_replace(text, '[^{kept}]+', '', 'g'))"

    def letters(self) -> str:
        """Latin letters: most characters of a text, so what is left of it is measured."""
        return f"length(regexp_replace(text, '[^A-Za-z]+', ''{', ' + repr('g') if self.name == 'duckdb' else ''}))"

    def pieces(self, pattern: str) -> str:
        """Stretches without what the class matches."""
        if self.name == "spark":
            return f"regexp_count(text, '{self._p(f'[^{pattern}]+')}')"
        return f"len(list_filter(string_split_regex(text, '[{pattern}]+'), lambda x: x <> ''))"

    def distinct(self, pattern: str) -> str:
        """Distinct stretches without what the class matches."""
        if self.name == "spark":
            return f"size(array_except(split(text, '{self._p(f'[{pattern}]+')}', -1), array('')))"
        return f"len(list_distinct(list_filter(string_split_regex(text, '[{pattern}]+'), lambda x: x <> '')))"


def rules(d: Dialect) -> dict[str, str]:
    """Name of each rule, and the condition to stay; never null for a text that isn't null.

    In Spark they read the columns `text` and `n_words` of :func:`_counted`.

    `repeated_words` asks for three distinct words in ten, or for five times the root
    of the number of words, whichever is less: a long text's vocabulary grows about
    as the root of its length (Heaps), so a share alone would reject every long text.
    """
    words, lines = r" \t\r\n", r"\r\n"
    n = "n_words" if d is SPARK else f"greatest(1, {d.pieces(words)})"
    return {
        "has_words": "length(regexp_replace(text, '[ \\t\\r\\n]+', '', 'g')) > 0" if d is DUCKDB else f"text RLIKE '{d._p(f'[^{words}]')}'",
        "shouting": f"{d.chars('A-Z')} <= 8 OR {d.chars('A-Z')} <= 0.4 * {d.letters()} + 8" if d is SPARK else f"{d.chars('A-Z')} <= 0.4 * {d.letters()} + 8",
        "symbols": f"{d.chars('#$%&*<>=@^_`{}~|')} <= 0.05 * length(text) + 8",
        "exclamations": f"{d.chars('!')} <= 0.3 * {n} + 3",
        "digits": f"{d.chars('0-9')} <= 0.3 * length(text) + 24",
        "word_length": f"length(text) <= 16.0 * {n} + 64",
        "repeated_words": f"{d.distinct(words)} >= least(0.3 * {n}, 5.0 * sqrt({n})) - 6",
        "repeated_lines": f"{d.distinct(lines)} >= 0.5 * {d.pieces(lines)} - 1",
    }


SPARK, DUCKDB = Dialect("spark"), Dialect("duckdb")


def _counted(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_words). Most texts are passed by all rules, three of which need their words: counted once, where it stands."""
    n = f"greatest(1, {SPARK.pieces(chr(32) + r'\t\r\n')}) + monotonically_increasing_id() * 0"  # not deterministic to the planner, which would copy it into every use
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("n_words", F.expr(n))


@dataclass
class Measured:
    name: str
    cost: float
    rejects: float


def measure(docs: DataFrame, most: int = SAMPLE_ROWS) -> list[Measured]:
    """Cost and selectivity of every rule on at most `most` documents, best first.

    Rules that tie keep the order of their names; on no documents none costs anything.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    text = F.col("text").cast("string")
    store = Store(docs.sparkSession, "rules")
    sample = store.keep(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(ids), "doc_id", "left_semi").filter("text is not null").repartition(1), "sample")  # one task: its seconds are the rule's

    def run(condition: str) -> tuple[float, float]:
        began = time.perf_counter()
        rejected = _counted(sample).select(F.expr(f"NOT ({condition})")).collect()
        return time.perf_counter() - began, sum(r[0] for r in rejected) / max(len(rejected), 1)

    run("n_words > 0")
    base = min(run("n_words > 0")[0] for _ in range(2))
    found = []
    for name, condition in rules(SPARK).items():
        seconds, share = min(run(condition) for _ in range(2))
        found.append(Measured(name, max(seconds - base, 1e-3), share))
    store.drop()
    return sorted(found, key=lambda m: (-(m.rejects + 1e-4) / m.cost, m.name))


def cascade(order: list[str]) -> str:
    """Name of the first rule in `order` that rejects a text, '' where none does."""
    conditions = rules(SPARK)
    return f"CASE WHEN text IS NULL THEN 'no_text' {' '.join(f"WHEN NOT ({conditions[n]}) THEN '{n}'" for n in order)} ELSE '' END"


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(doc_id, keep) of every row of `docs`, null doc_ids and repeated rows too.

    Null, empty and blank texts don't stay.  Texts of any length are judged whole,
    and those that repeat alike.  No rows give no rows.  Other columns are not read,
    so their names don't matter.
    """
    order = order if order is not None else [m.name for m in measure(docs)]
    return _counted(docs).select("doc_id", (F.expr(cascade(order)) == "").alias("keep"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


SQL = "SELECT doc_id, coalesce(" + " AND ".join(f"({c})" for c in rules(DUCKDB).values()) + ", false) AS keep FROM documents"
