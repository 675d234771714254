"""Content-derived identifiers; equal inputs give equal ids on any engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _short(text: Column) -> Column:
    return F.substring(F.sha1(text), 1, 10)


def mention_id(doc_id: Column, start: Column, end: Column, source: Column) -> Column:
    """Of a span; a human's spans have a prefix of their own and leave the source out of the hash."""
    place = F.concat_ws(":", doc_id, start.cast("string"), end.cast("string"))
    return F.when(source == "human", F.concat(F.lit("human_"), _short(place))).otherwise(F.concat(F.lit("m_"), _short(F.concat_ws(":", place, source))))


def entity_id(doc_id: Column, mention_ids: Column) -> Column:
    return F.concat(F.lit("e_"), _short(F.concat(doc_id, F.lit("|"), F.array_join(F.array_sort(mention_ids), "|"))))


def cluster_id(kind: Column, canonical: Column, doc_ids: Column) -> Column:
    """Of a type, a canonical name and the distinct documents."""
    docs = F.array_join(F.array_sort(F.array_distinct(doc_ids)), "|")
    return F.concat(F.lit("c_"), _short(F.concat(kind, F.lit("|"), canonical, F.lit("|"), docs)))


def text_sha(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def safe_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^\p{L}\p{N}\-_.]", "_")


def member_ref(doc_id: Column, entity: Column) -> Column:
    return F.concat(doc_id, F.lit("/"), entity)
