"""Model plug points and local deterministic backends.

A backend is pickled to the executors, so it loads its model on first use there.
Remote language models fit :class:`ToolClient`, given a function that sends one
request; model and client libraries are imported only when they are used.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import logging
import re
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol, runtime_checkable

import numpy as np

from .schema import EntitySchema

log = logging.getLogger(__name__)


class BackendError(RuntimeError):
    """A backend that failed for good, or whose answer breaks its contract."""


@dataclass(frozen=True)
class Prediction:
    start: int
    end: int
    label: str
    score: float


@dataclass(frozen=True)
class Group:
    """Mentions of one document that are one entity."""

    mention_ids: tuple[str, ...]
    canonical: str
    type: str
    confidence: float
    rationale: str = ""


@dataclass(frozen=True)
class Merge:
    """Where a borderline entity goes; no target: nowhere."""

    entity_id: str
    target: str | None
    confidence: float
    rationale: str = ""


@runtime_checkable
class Extractor(Protocol):
    model_id: str

    def predict(self, text: str, schema: EntitySchema) -> Sequence[Prediction]: ...


@runtime_checkable
class CorefClient(Protocol):
    model_id: str

    def group(self, doc_id: str, text: str, mentions: Sequence[dict[str, Any]], schema: EntitySchema) -> Sequence[Group]: ...


@runtime_checkable
class TieBreaker(Protocol):
    model_id: str

    def decide(self, candidates: Sequence[dict[str, Any]], clusters: dict[str, str]) -> Sequence[Merge]: ...


@runtime_checkable
class Embedder(Protocol):
    model_id: str

    def encode(self, texts: Sequence[str]) -> np.ndarray: ...


@dataclass
class KeywordExtractor:
    """Words of a list, by label; the first occurrence or all of them."""

    keywords: dict[str, list[str]]
    score: float = 0.9
    model_id: str = "keywords"

    def predict(self, text: str, schema: EntitySchema) -> list[Prediction]:
        return [Prediction(m.start(), m.end(), label, self.score) for label, words in self.keywords.items() for w in words for m in re.finditer(re.escape(w), text)]


@dataclass
class SameSurfaceCoref:
    """Mentions of one type and equal text, whatever its case, are one entity."""

    confidence: float = 0.9
    model_id: str = "same-surface"

    def key(self, mention: dict[str, Any]) -> str:
        return mention["text"].lower()

    def group(self, doc_id: str, text: str, mentions: Sequence[dict[str, Any]], schema: EntitySchema) -> list[Group]:
        found: dict[tuple[str, str], list[dict[str, Any]]] = {}
        for m in mentions:
            found.setdefault((m["type"], self.key(m)), []).append(m)
        return [Group(tuple(m["id"] for m in ms), max(ms, key=lambda m: len(m["text"]))["text"], kind, self.confidence) for (kind, _), ms in found.items()]


@dataclass
class FirstWordCoref(SameSurfaceCoref):
    """Mentions of one type whose first words agree are one entity."""

    model_id: str = "first-word"

    def key(self, mention: dict[str, Any]) -> str:
        return mention["text"].split()[0].lower() if mention["text"].split() else ""


@dataclass
class NearestTieBreaker:
    """Sends every candidate to its nearest cluster, or from a similarity on."""

    least: float = 0.0
    confidence: float = 0.9
    model_id: str = "nearest"

    def decide(self, candidates: Sequence[dict[str, Any]], clusters: dict[str, str]) -> list[Merge]:
        return [Merge(c["entity_id"], c["nearest_cluster_id"] if (c["nearest_similarity"] or 0) >= self.least else None, self.confidence) for c in candidates]


@dataclass
class HashedEmbedder:
    """Unit vectors from hashed character n-grams."""

    dim: int = 64
    n: int = 3
    model_id: str = "hashed-ngrams"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, 0), dtype=np.float32)
        out = np.zeros((len(texts), self.dim))
        for k, text in enumerate(texts):
            t = f" {text.lower()} "
            for i in range(max(1, len(t) - self.n + 1)):
                h = int.from_bytes(hashlib.md5(t[i : i + self.n].encode()).digest()[:8], "big")
                out[k, h % self.dim] += 1 if h >> 63 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class FirstLetterEmbedder:
    """One axis for each first letter; for tests."""

    model_id: str = "first-letter"

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, 0), dtype=np.float32)
        out = np.zeros((len(texts), 27), dtype=np.float32)
        for k, text in enumerate(texts):
            c = text[:1].lower()
            out[k, ord(c) - 97 if "a" <= c <= "z" else 26] = 1
        return out


def checked_groups(groups: Sequence[Group], mentions: Sequence[dict[str, Any]], schema: EntitySchema) -> list[Group]:
    """The groups, if they are a partition of the mentions with types of the schema."""
    wanted, seen = {m["id"] for m in mentions}, []
    for g in groups:
        if not g.mention_ids:
            raise BackendError("a group has no mentions")
        if schema.type_by_name(g.type) is None:
            raise BackendError(f"unknown type {g.type!r}")
        if not 0 <= g.confidence <= 1:
            raise BackendError(f"confidence {g.confidence} isn't between 0 and 1")
        seen += g.mention_ids
    if unknown := sorted(set(seen) - wanted):
        raise BackendError(f"unknown mentions {unknown}")
    if again := sorted({m for m in seen if seen.count(m) > 1}):
        raise BackendError(f"mentions in two places {again}")
    if missing := sorted(wanted - set(seen)):
        raise BackendError(f"mentions in no group {missing}")
    return list(groups)


def checked_merges(merges: Sequence[Merge], entity_ids: Sequence[str], clusters: dict[str, str]) -> list[Merge]:
    """The decisions, if there is one for each entity and all targets exist."""
    found = {m.entity_id for m in merges}
    if unknown := sorted(found - set(entity_ids)):
        raise BackendError(f"decisions on unknown entities {unknown}")
    if targets := sorted({m.target for m in merges if m.target is not None} - set(clusters)):
        raise BackendError(f"unknown clusters {targets}")
    if missing := sorted(set(entity_ids) - found):
        raise BackendError(f"no decision on {missing}")
    return list(merges)


_TEXT, _SHARE = dict(type="string"), dict(type="number", minimum=0, maximum=1)


def _tool(name: str, told: str, rows: str, optional: tuple[str, ...], **fields: dict) -> dict[str, Any]:
    """A tool whose argument `rows` is a list of objects of these fields."""
    row = dict(type="object", properties=fields, required=[f for f in fields if f not in optional])
    listed = {rows: dict(type="array", items=row)}
    return dict(name=name, description=told, input_schema=dict(type="object", properties=listed, required=[rows]))


GROUP_TOOL = _tool("report_entities", "Report every entity of the document with the ids of all its mentions.", "clusters", ("rationale",), mention_ids=dict(type="array", items=_TEXT, minItems=1), canonical=_TEXT, type=_TEXT, confidence=_SHARE, rationale=_TEXT)
MERGE_TOOL = _tool("report_merges", "For every candidate say which cluster it joins, or null if none.", "decisions", ("rationale",), entity_id=_TEXT, target_cluster_id=dict(type=["string", "null"]), confidence=_SHARE, rationale=_TEXT)
GROUP_PROMPT = "You sort the marked mentions of one document into entities. Each mention belongs to exactly one entity. Name an entity by its fullest form. Answer only through the tool."
MERGE_PROMPT = "You decide whether an entity is the same thing in the world as the cluster nearest to it. Prefer null if the contexts don't settle it. Answer only through the tool."


def schema_block(schema: EntitySchema) -> str:
    """The types as text that opens every prompt, so that a server can cache it."""
    return "Entity types:\n" + "\n".join(f"- {t.name}: {t.description}" + (f" (such as {', '.join(t.examples)})" if t.examples else "") for t in schema.types)


def group_payload(text: str, mentions: Sequence[dict[str, Any]]) -> str:
    rows = [{"id": m["id"], "start": m["start"], "end": m["end"], "text": m["text"], "type": m["type"], "score": round(m["score"], 3)} for m in mentions]
    return f"<document>\n{text}\n</document>\n<mentions>\n{json.dumps(rows, ensure_ascii=False)}\n</mentions>"


def as_function(tool: dict[str, Any]) -> dict:
    """A tool in the form that chat-completion servers take."""
    inner = {k: v for k, v in tool.items() if k != "input_schema"} | dict(parameters=tool["input_schema"])
    return dict(type="function", function=inner)


@dataclass
class ToolClient:
    """Coreference and tie-breaks by a language model that is made to call a tool.

    `send(system, schema_block, prompt, tool)` returns (arguments, usage): the tool's
    arguments, as a mapping or JSON text, and token counts by name.  A failed call, or
    an answer that isn't valid, is tried again at once, `attempts` times in all.
    """

    send: Callable[[str, str, str, dict[str, Any]], tuple[Any, dict[str, int]]]
    model_id: str = "tool-client"
    attempts: int = 3
    usage: dict[str, int] = field(default_factory=dict)

    @property
    def cache_hit_ratio(self) -> float | None:
        """Share of input tokens that a server read from its cache; None before any call."""
        total = sum(self.usage.get(k, 0) for k in ("input_tokens", "cache_read_tokens", "cache_write_tokens"))
        return self.usage.get("cache_read_tokens", 0) / total if total else None

    def _call(self, system: str, block: str, prompt: str, tool: dict[str, Any], take: Callable[[dict[str, Any]], Any]) -> Any:
        last: Exception | None = None
        for k in range(self.attempts):
            try:
                arguments, usage = self.send(system, block, prompt, tool)
                for name, n in usage.items():
                    self.usage[name] = self.usage.get(name, 0) + n
                return take(json.loads(arguments) if isinstance(arguments, str) else arguments)
            except Exception as e:  # whatever the transport raises
                last = e
                log.warning("attempt %d of %d failed: %s", k + 1, self.attempts, e)
        raise BackendError(f"{tool['name']} failed {self.attempts} times: {last}") from last

    def group(self, doc_id: str, text: str, mentions: Sequence[dict[str, Any]], schema: EntitySchema) -> list[Group]:
        if not mentions:
            return []

        def take(a: dict[str, Any]) -> list[Group]:
            return checked_groups([Group(tuple(c["mention_ids"]), c["canonical"], c["type"], float(c["confidence"]), c.get("rationale", "")) for c in a["clusters"]], mentions, schema)

        return self._call(GROUP_PROMPT, schema_block(schema), group_payload(text, mentions), GROUP_TOOL, take)

    def decide(self, candidates: Sequence[dict[str, Any]], clusters: dict[str, str]) -> list[Merge]:
        if not candidates:
            return []
        prompt = json.dumps({"candidates": list(candidates), "clusters": clusters}, ensure_ascii=False)

        def take(a: dict[str, Any]) -> list[Merge]:
            return checked_merges([Merge(d["entity_id"], d["target_cluster_id"], float(d["confidence"]), d.get("rationale", "")) for d in a["decisions"]], [c["entity_id"] for c in candidates], clusters)

        return self._call(MERGE_PROMPT, "", prompt, MERGE_TOOL, take)


@dataclass
class SpanModelExtractor:
    """A zero-shot span model (library `gliner`), loaded on first use where it runs."""

    model_id: str = "urchade/gliner_large-v2.5"
    threshold: float = 0.4
    flat: bool = False
    multi_label: bool = True
    device: str = "cpu"

    def _model(self) -> Any:
        return _loaded(("gliner", self.model_id, self.device), lambda: importlib.import_module("gliner").GLiNER.from_pretrained(self.model_id).to(self.device))

    def predict(self, text: str, schema: EntitySchema) -> list[Prediction]:
        if not text.strip():
            return []
        found = self._model().predict_entities(text, schema.type_names, threshold=self.threshold, flat_ner=self.flat, multi_label=self.multi_label)
        return [Prediction(int(p["start"]), int(p["end"]), p["label"], float(p["score"])) for p in found]


@dataclass
class SentenceEmbedder:
    """A sentence encoder (library `sentence_transformers`) with unit vectors, loaded on first use where it runs."""

    model_id: str = "BAAI/bge-small-en-v1.5"
    device: str | None = None

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        if not len(texts):
            return np.zeros((0, 0), dtype=np.float32)
        model = _loaded(("sentences", self.model_id, self.device), lambda: importlib.import_module("sentence_transformers").SentenceTransformer(self.model_id, device=self.device))
        return np.asarray(model.encode(list(texts), normalize_embeddings=True), dtype=np.float32)


_models: dict[tuple, Any] = {}


def _loaded(key: tuple, load: Callable[[], Any]) -> Any:
    """One model a process, however many copies of its backend were sent there."""
    if key not in _models:
        try:
            _models[key] = load()
        except ModuleNotFoundError as e:
            raise BackendError(f"this backend needs the library {e.name}") from e
    return _models[key]


@dataclass
class MessagesTransport:
    """Sends a tool call through the client library `anthropic`; the schema block is marked for the server's cache."""

    model: str
    max_tokens: int = 8192

    def __call__(self, system: str, block: str, prompt: str, tool: dict[str, Any]) -> tuple[Any, dict[str, int]]:
        client = _loaded(("messages",), lambda: importlib.import_module("anthropic").Anthropic())
        parts = [dict(type="text", text=t) for t in (system, block) if t]
        parts[-1]["cache_control"] = dict(type="ephemeral")
        answer = client.messages.create(model=self.model, max_tokens=self.max_tokens, system=parts, messages=[dict(role="user", content=prompt)], tools=[tool], tool_choice=dict(type="tool", name=tool["name"]))
        found = [c.input for c in answer.content if c.type == "tool_use"]
        if not found:
            raise BackendError("the answer has no tool call")
        counts = dict(input_tokens=answer.usage.input_tokens, output_tokens=answer.usage.output_tokens)
        counts |= dict(cache_read_tokens=getattr(answer.usage, "cache_read_input_tokens", 0) or 0, cache_write_tokens=getattr(answer.usage, "cache_creation_input_tokens", 0) or 0)
        return found[0], counts


@dataclass
class ChatTransport:
    """Sends a tool call to a server of chat completions, by HTTP."""

    model: str
    url: str
    key: str = field(default="", repr=False)
    timeout: float = 120.0

    def __call__(self, system: str, block: str, prompt: str, tool: dict[str, Any]) -> tuple[Any, dict[str, int]]:
        function = as_function(tool)
        messages = [dict(role="system", content="\n\n".join(filter(None, (system, block)))), dict(role="user", content=prompt)]
        body = dict(model=self.model, messages=messages, tools=[function], tool_choice=dict(type="function", function=dict(name=tool["name"])))
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        asked = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        with urllib.request.urlopen(asked, timeout=self.timeout) as got:
            answer = json.load(got)
        calls = answer["choices"][0]["message"].get("tool_calls") or []
        if not calls:
            raise BackendError("the answer has no tool call")
        used = answer.get("usage") or {}
        read = (used.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
        return calls[0]["function"]["arguments"], dict(input_tokens=used.get("prompt_tokens", 0) - read, output_tokens=used.get("completion_tokens", 0), cache_read_tokens=read)
