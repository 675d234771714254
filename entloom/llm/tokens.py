"""A token count that JVM and SQL engines compute alike, for mixing and packing.

Pieces of up to six letters, up to three digits, or one other sign: about what
subword vocabularies make of text.  Both operators take any other column instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = r"[\p{L}\p{M}]{1,6}|\p{N}{1,3}|[^\p{L}\p{M}\p{N} \t\r\n]"


def count(text: Column) -> Column:
    """Tokens of a text; 0 where it is null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(PIECE)), F.lit(0)).cast("long")


def counted_once(text: Column) -> Column:
    """As :func:`count`, but never copied into a filter or into a second use by the optimizer.

    The added zero isn't deterministic to the planner, which therefore evaluates
    the expression where it stands, once a row.
    """
    return count(text) + F.monotonically_increasing_id() * 0
