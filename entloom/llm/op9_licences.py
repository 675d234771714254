"""Licence scans by canonical digest lookup (operator 9).

A text is brought to a canonical form (lower case, no copyright statements, one spelling
for words that have several, no punctuation, single blanks) and its SHA-256 digest
joined to the digests of known licences.  Entire texts are compared.  A line that
speaks of a licence is looked up in the same way, as an entire text of its own, so
that a document's licence notice is found too.
"""

from __future__ import annotations

import functools
import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.documents import spread
from .licences import DIGESTS, ENTIRE, KNOWN

_SIGNS = r"[^\p{L}\p{M}\p{N}]+"
#: Of the SQL: every line that begins with one of these.
_COPYRIGHT = r"(?m)^[^\p{L}\p{N}\n]*(?:copyright|\(c\)|©|all rights reserved)[^\n]*$"
#: What follows "copyright", or "(c)" as an item's number, within a licence; anything else is a holder's name.
_BODY = r"also|and|are|as|disclaimers?|doctrines?|holders?|if|in|interests?|is|laws?|licen[cs]es?|like|lines?|notices?|of|on|or|owners?|ownership|patent|permissions?|protection|resulting|statements?|the[ \t\r\n]+(?:library|program|software)|those|to|treat(?:y|ies)|that|which"
_ITEM = "a|all|an|any|each|for|if|in|or|representations|the|to|under|you"
#: With these a licence goes on after a copyright statement in the same line.
_OPENING = "everyone is permitted|licen[cs]ed under|permission is (?:hereby )?granted|permission to use|redistribution and use|released under|this (?:file|library|program|software) is (?:distributed|free software|licen[cs]ed|provided|released)"
_SIGN = r"\(c\)|©|[0-9]{4}|[<\[{]"


def _statement(letter: str, lead: str) -> str:
    """A copyright statement in lower case, for Java and Python: to the line's end or up to a licence's opening; in mid-line only up to one."""
    end = rf"(?!{letter})"
    own = rf"copyright[ \t]*(?:{_SIGN})|copyright[ \t:]+(?!(?:{_BODY}){end}){letter}|©|\(c\)[ \t]*(?:copyright{end}|{_SIGN})|\(c\)[ \t]+(?!(?:{_ITEM}){end}){letter}|all rights reserved{end}"
    return rf"(?<![^\r\n]){lead}(?:{own})[^\r\n]*?(?={_OPENING}|(?![^\r\n]))|(?<!{letter})copyright[ \t]*(?:{_SIGN})[^\r\n]*?(?={_OPENING})"


_STATEMENT = _statement(r"[\p{L}\p{N}]", r"[^\p{L}\p{N}\r\n]*")
_PYTHON_STATEMENT = _statement(r"[^\W_]", r"(?:[^\w\r\n]|_)*")
#: Words of one meaning, in canonical form, after punctuation has gone; found as whole words.
SPELLINGS = {
    "licence": "license", "licences": "licenses", "licenced": "licensed", "sub license": "sublicense", "acknowledgement": "acknowledgment", "favour": "favor", "fulfil": "fulfill", "judgement": "judgment", "merchantibility": "merchantability",
    "modelled": "modeled", "non infringement": "noninfringement", "per cent": "percent", "recognise": "recognize", "organisation": "organization", "rights owner": "copyright holder", "copyright owner": "copyright holder", "version 2 0 of": "version 2 of", "http": "https", "whilst": "while", "wilful": "willful",
}
#: One of these is in every text that has such a word; a plain search for each is cheaper than one expression for all.
_HAS_SPELLING = ("licence", "sub licen", "gement", "favour", "fulfil", "merchantib", "modelled", "non infr", "per cent", "recognise", "organisation", "s owner", "t owner", "version 2 0", "http", "whilst", "wilful")


def canonical_text(text: str) -> str:
    """The canonical form in Python; the same as :func:`canonical`."""
    t = re.sub(_PYTHON_STATEMENT, "", text.lower())
    t = "".join(c if c.isalnum() else " " for c in t)
    t = " ".join(t.split())
    for a, b in SPELLINGS.items():
        t = re.sub(rf"(^| ){a}( |$)", rf"\g<1>{b}\g<2>", t)
    return t


def canonical(text: Column) -> Column:
    """The canonical form of a text; a step whose words can't occur is skipped by a plain search."""
    t = F.lower(text)
    marks = t.contains("copyright") | t.contains("(c)") | t.contains("©") | t.contains("all rights reserved")
    t = F.when(marks, F.regexp_replace(t, _STATEMENT, "")).otherwise(t)
    t = F.trim(F.regexp_replace(t, _SIGNS, " "))
    some = functools.reduce(Column.__or__, [t.contains(x) for x in _HAS_SPELLING])
    fixed = t
    for a, b in SPELLINGS.items():
        fixed = F.regexp_replace(fixed, f"(^| ){a}( |$)", f"$1{b}$2")
    return F.when(some, fixed).otherwise(t)


@functools.cache
def digests() -> dict[str, str]:
    """Licence of each known digest."""
    return DIGESTS | {hashlib.sha256(canonical_text(text).encode()).hexdigest(): name for name, text in KNOWN} | ENTIRE


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, license, notices) of every row of `docs`, null doc_ids and repeated rows too.

    `license` is the licence whose entire text the document is, null if none.
    Known are the texts of ISC, 0BSD, BSD-2/3, Zlib, MIT, Unlicense, Apache-2.0,
    GPL-1/2/3, LGPL-2/2.1/3, MPL-1.1/2.0, GFDL-1.2/1.3, CC0-1.0 and Artistic-1.0
    (Perl); not AGPL, EPL, BSL and the other CC licences, nor changed editions.
    `notices` are the licences that lines of it name, sorted, joined by commas, ''
    if none.  A null text has a null digest and no notices; an empty text, or one
    of punctuation or copyright statements alone, has the digest of the empty text,
    which is no licence.  Texts and lines of any length are taken whole; rows that
    repeat are looked up alike.  No rows give no rows.  Other columns are not read,
    so their names don't matter.
    """
    spark = docs.sparkSession
    known = spark.createDataFrame(list(digests().items()), "digest string, license string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    by_digest = F.create_map(*[F.lit(x) for kv in digests().items() for x in kv])
    lines = F.filter(F.split("text", "[\r\n]+"), lambda x: F.lower(x).contains("licen"))
    found = F.transform(lines, lambda x: F.try_element_at(by_digest, F.sha2(canonical(x), 256)))
    notices = F.when(F.col("text").contains("icen") | F.col("text").contains("ICEN"), F.array_join(F.array_sort(F.array_distinct(F.filter(found, lambda x: x.isNotNull()))), ",")).otherwise("")
    rows = rows.select("doc_id", F.sha2(canonical(F.col("text")), 256).alias("digest"), F.coalesce(notices, F.lit("")).alias("notices"))
    return rows.join(F.broadcast(known), "digest", "left").select("doc_id", "digest", "license", "notices")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def _sql() -> str:
    """The scan in SQL, but for one limit: RE2 can't look around, so any line that begins with 'copyright' is taken out whole."""

    def canon(x: str) -> str:
        t = f"regexp_replace(lower({x}), '{_COPYRIGHT}', '', 'g')"
        t = f"trim(regexp_replace({t}, '{_SIGNS}', ' ', 'g'))"
        for a, b in SPELLINGS.items():
            t = f"regexp_replace({t}, '(^| ){a}( |$)', '\\1{b}\\2', 'g')"
        return t

    known = ", ".join(f"('{d}', '{n}')" for d, n in digests().items())
    return f"""WITH known(digest, license) AS (VALUES {known}),
docs AS (SELECT doc_id, text, sha256({canon('text')}) AS digest FROM documents),
lines AS (SELECT doc_id, unnest(string_split_regex(text, '[\\r\\n]+')) AS line FROM documents WHERE regexp_matches(text, 'icen|ICEN')),
named AS (SELECT DISTINCT l.doc_id, k.license FROM lines l JOIN known k ON sha256({canon('l.line')}) = k.digest
    WHERE contains(lower(l.line), 'licen')),
notices AS (SELECT doc_id, string_agg(license, ',' ORDER BY license) AS notices FROM named GROUP BY doc_id)
SELECT d.doc_id, d.digest, k.license, coalesce(n.notices, '') AS notices
FROM docs d LEFT JOIN known k USING (digest) LEFT JOIN notices n USING (doc_id)"""


SQL = _sql()
