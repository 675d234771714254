"""Structured Streaming over incremental resolution.

Each micro-batch is resolved against the registry and centroids that the batch
before left, versioned by batch id: a batch that is run again after a failure
reads the version before its own and writes the same one, so state is exact.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..backends import TieBreaker
from ..model import CENTROID, REGISTRY
from ..operators.cluster import BORDERLINE, MERGE
from ..operators.incremental import resolve_incremental
from ..sources import files


class ResolutionState:
    """Versions of registry, centroids and tagged entities under a folder that all executors share."""

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.root = spark, str(root).rstrip("/")

    def _path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/v{version:08d}"

    def _version_before(self, batch: int) -> int | None:
        """The last whole version before a batch's own, from one listing."""
        there = sorted((int(name[1:]) for name in files.names_in(self.spark, f"{self.root}/centroids") if int(name[1:]) < batch), reverse=True)
        return next((v for v in there if files.exists(self.spark, f"{self._path('centroids', v)}/_SUCCESS")), None)

    def before(self, batch: int) -> tuple[DataFrame, DataFrame]:
        """Registry and centroids as the last batch before `batch` left them; empty at first."""
        version = self._version_before(batch)
        if version is None:
            return self.spark.createDataFrame([], REGISTRY), self.spark.createDataFrame([], CENTROID)
        return self.spark.read.schema(REGISTRY).parquet(self._path("registry", version)), self.spark.read.schema(CENTROID).parquet(self._path("centroids", version))

    def forget(self, batch: int) -> None:
        """Drops the registries and centroids that no batch reads any more: older than the version before `batch`, which a rerun of it needs."""
        least = self._version_before(batch)
        for name in ("registry", "centroids"):
            for version in files.names_in(self.spark, f"{self.root}/{name}"):
                if least is not None and int(version[1:]) < least:
                    files.delete(self.spark, f"{self.root}/{name}/{version}")

    def write(self, batch: int, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(self._path(name, batch))

    def entities(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/entities/*")


def resolve_stream(entities: DataFrame, state: ResolutionState, checkpoint: str, embedder_id: str, tiebreaker: TieBreaker | None = None, merge: float = MERGE, borderline: float = BORDERLINE, **trigger) -> StreamingQuery:
    """Starts resolution of a stream of entities that have vectors."""

    def step(batch: DataFrame, batch_id: int) -> None:
        registry, centroids = state.before(batch_id)
        found = resolve_incremental(batch, registry, centroids, embedder_id, tiebreaker, merge, borderline)
        state.write(batch_id, "entities", found.entities)
        state.write(batch_id, "registry", found.registry)
        state.write(batch_id, "centroids", found.centroids)  # last: its presence says that the version is whole
        state.forget(batch_id)

    return entities.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
