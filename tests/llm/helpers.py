"""Small fixtures that every operator must stand: nulls, empties, very long texts, repeats, other columns of clashing names."""

from pyspark.sql import types as T

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over a lazy dog while seven grey wolves watch from behind old stone walls near two rivers".split()


def prose(seed: int, n: int = 60) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (f"{r.randrange(1000)}" if r.random() < 0.3 else "") for _ in range(n)).capitalize() + "."


def awkward(spark):
    """Rows that trouble operators; one doc_id comes twice, one is null."""
    rows = [
        (1, prose(1), "en", "a", 1), (2, "", "en", "a", 0), (3, None, None, None, None), (4, "   \n\t ", "en", "b", 6), (5, prose(5, 30_000), "en", "b", 1), (6, "word", "en", None, 4), (7, prose(1), "en", "a", 1),
        (None, prose(8), "en", "a", 1), (9, prose(9), "de", "a", 1), (9, prose(9), "de", "a", 1), (10, "é" * 50 + " ñandú 😀   end", "es", "c", 60), (11, "!!! ??? ###", None, "", 11),
    ]
    return spark.createDataFrame(rows, DOC)


def clashing(df):
    """The same rows with columns named like those that operators use inside."""
    from pyspark.sql import functions as F

    names = "id key tokens n copies rate shard found bands root quality language x digest license label keep redacted k doc version row gone_doc gone_version seen n_words node lead part text_ Text2 piece window".split()
    for name in (*names, *(f"_{n}" for n in ("tokens", "language", "row")), *(f"__{n}" for n in ("id", "k", "tokens", "copies", "language", "redacted", "rank", "seen")), "a.b", "TOKENS_", "c`d"):
        df = df.withColumn(name, F.lit("clash"))
    return df.withColumn("map", F.create_map(F.lit("a"), F.lit(1)))


def empty(spark):
    return spark.createDataFrame([], T._parse_datatype_string(DOC))


def ids(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is None, str(x)) for x in t))
