"""The user's entity types."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class EntityType:
    name: str
    description: str
    examples: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if not self.name or not self.description:
            raise ValueError("an entity type needs a name and a description")
        object.__setattr__(self, "examples", tuple(self.examples))


@dataclass(frozen=True)
class EntitySchema:
    types: tuple[EntityType, ...]
    version: str = field(default="1")

    def __post_init__(self) -> None:
        object.__setattr__(self, "types", tuple(self.types))
        if not self.types:
            raise ValueError("a schema needs at least one type")
        if len(set(self.type_names)) != len(self.types):
            raise ValueError(f"type names repeat: {self.type_names}")

    @property
    def type_names(self) -> list[str]:
        return [t.name for t in self.types]

    def type_by_name(self, wanted: str) -> EntityType | None:
        return {t.name: t for t in self.types}.get(wanted)

    def fingerprint(self) -> str:
        """16 hex digits that change with any field, and with the order of types or examples."""
        compact = json.JSONEncoder(separators=(",", ":"), sort_keys=True).encode(self.to_dict())
        return hashlib.sha256(compact.encode()).hexdigest()[:16]

    def to_dict(self) -> dict:
        types = [asdict(t) for t in self.types]
        for t in types:
            t["examples"] = list(t["examples"])
        return dict(version=self.version, types=types)

    @classmethod
    def from_dict(cls, data: object) -> EntitySchema:
        if not isinstance(data, dict):
            raise ValueError("a schema is a mapping with `types`")
        if extra := set(data) - {"version", "types"}:
            raise ValueError(f"unknown keys in schema: {sorted(extra)}")
        types = []
        for t in data.get("types") or []:
            if extra := set(t) - {"name", "description", "examples"}:
                raise ValueError(f"unknown keys in type: {sorted(extra)}")
            types.append(EntityType(t.get("name", ""), t.get("description", ""), tuple(t.get("examples") or ())))
        return cls(tuple(types), str(data.get("version", "1")))

    def frame(self, spark: SparkSession) -> DataFrame:
        """A row for each type: (name, description, examples, ord)."""
        rows = [(t.name, t.description, [*t.examples], k) for k, t in enumerate(self.types)]
        return spark.createDataFrame(rows, "name string, description string, examples array<string>, ord int")


DEFAULT_SCHEMA = EntitySchema(
    (
        EntityType("Person", "A named human being", ("Ada Lovelace", "Alan Turing")),
        EntityType("Organization", "A company, institution, agency or other named group", ("CERN", "Red Cross")),
        EntityType("Location", "A named place: country, city, region or landmark", ("Nairobi", "the Alps")),
    )
)


Place = str | Path


def parse_schema(text: str, suffix: str) -> EntitySchema:
    """Of YAML or JSON text, told by a file name's suffix."""
    if suffix in (".yaml", ".yml"):
        import yaml

        return EntitySchema.from_dict(yaml.safe_load(text))
    if suffix == ".json":
        return EntitySchema.from_dict(json.loads(text))
    raise ValueError(f"a schema is .yaml, .yml or .json, not {suffix!r}")


def schema_text(schema: EntitySchema, suffix: str) -> str:
    if suffix in (".yaml", ".yml"):
        import yaml

        return yaml.safe_dump(schema.to_dict(), sort_keys=False, allow_unicode=True)
    if suffix == ".json":
        return json.dumps(schema.to_dict(), indent=2, ensure_ascii=False)
    raise ValueError(f"a schema is .yaml, .yml or .json, not {suffix!r}")


def load_schema(path: Place) -> EntitySchema:
    """Reads .yaml, .yml or .json."""
    path = Path(path)
    if not path.exists():
        raise FileNotFoundError(f"no schema at {path}")
    return parse_schema(path.read_text(encoding="utf-8"), path.suffix)


def save_schema(schema: EntitySchema, path: Place) -> None:
    path = Path(path)
    text = schema_text(schema, path.suffix)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
