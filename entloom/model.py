"""Row types of the tables: documents, mentions, entities, registry, centroids, review, gold."""

from __future__ import annotations

from pyspark.sql import types as T

MENTION_SOURCES = ("gliner", "llm", "human", "regex")
REVIEW_REASONS = ("low_span_conf", "low_cluster_conf", "ambiguous_merge", "type_uncertain")
REVIEW_OPS = ("keep", "reject", "edit", "add")
REVIEW_FORMAT = "entloom/review/v1"

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "array<string>": T.ArrayType(T.StringType()), "array<double>": T.ArrayType(T.DoubleType())}


def _struct(fields: str) -> T.StructType:
    """Of "name type, ..."; Spark's own parser needs a session, which there isn't on import."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


DOCUMENT = _struct("doc_id string, text string, source string, metadata string")
SPAN = _struct("start int, end int, text string")
MENTION = _struct("id string, start int, end int, text string, type string, score double, source string, metadata string")
MENTION_ROW = T.StructType([T.StructField("doc_id", T.StringType()), *MENTION.fields])
ENTITY = T.StructType(
    [
        *_struct("doc_id string, entity_id string, type string, canonical string, surface_canonical string, confidence double, cluster_id string").fields,
        T.StructField("mentions", T.ArrayType(MENTION)),
    ]
)
COREF = _struct("doc_id string, mention_ids array<string>, canonical string, type string, confidence double, rationale string")
ASSIGNMENT = _struct("doc_id string, entity_id string, cluster_id string, top_similarity double, second_similarity double, source string")
CANDIDATE = _struct("doc_id string, entity_id string, type string, canonical string, contexts array<string>, nearest_cluster_id string, nearest_similarity double")
DECISION = _struct("doc_id string, entity_id string, target_cluster_id string, confidence double, rationale string")
REGISTRY = _struct("cluster_id string, canonical string, type string, members array<string>")
CENTROID = _struct("cluster_id string, type string, centroid array<double>, size int, embedder_id string")
REVIEW_MENTION = _struct("id string, start int, end int, text string, score double, source string")
REVIEW_LINE = T.StructType(
    [
        *_struct("op string, id string, type string, canonical string, surface_canonical string, confidence double").fields,
        T.StructField("mentions", T.ArrayType(REVIEW_MENTION)),
        *_struct("cluster_id string, reason string, candidates array<string>").fields,
    ]
)
GOLD = _struct("doc_id string, entity_id string, gold_cluster_id string")
LINT = _struct("file string, line int, message string")


_REVIEW_HEADER = _struct("$schema string, doc_id string, text_sha string, schema_version string")
_ENUMS = {"op": REVIEW_OPS, "reason": REVIEW_REASONS, "source": MENTION_SOURCES, "$schema": (REVIEW_FORMAT,)}
_NEEDED = {"id", "type", "canonical", "mentions", "start", "end", "text", *_REVIEW_HEADER.fieldNames()}


def _json_schema(kind: T.DataType, optional: frozenset[str] = frozenset()) -> dict:
    if isinstance(kind, T.StructType):
        fields = {f.name: {"enum": list(_ENUMS[f.name])} if f.name in _ENUMS else _json_schema(f.dataType, frozenset({"id"})) for f in kind}
        return dict(type="object", additionalProperties=False, properties=fields, required=[n for n in fields if n in _NEEDED - optional])
    if isinstance(kind, T.ArrayType):
        return dict(type="array", items=_json_schema(kind.elementType, optional))
    return dict(type={"string": "string", "int": "integer", "double": "number"}[kind.simpleString()])


def review_json_schema() -> dict:
    """JSON Schema of a review file's lines, for editors; it follows the row types above."""
    return dict(title=REVIEW_FORMAT, oneOf=[_json_schema(_REVIEW_HEADER), _json_schema(REVIEW_LINE)])
