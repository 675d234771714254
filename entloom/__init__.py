"""Entity extraction and resolution on Spark DataFrames."""

from .schema import DEFAULT_SCHEMA, EntitySchema, EntityType, load_schema, save_schema

__all__ = ["DEFAULT_SCHEMA", "EntitySchema", "EntityType", "load_schema", "save_schema"]
__version__ = "0.1.0"
