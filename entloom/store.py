"""Intermediate tables in the folder that all executors share.

Every table written here replaces lineage, so a lost executor costs a reread and
not a recomputation.  The folder is ``spark.checkpoint.dir``; it is set here only
where the session has none, and only for a master on one machine.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Unset on ``local[...]`` (tests), a folder is made and set; unset on a cluster
    it is an error, because a machine-local folder isn't seen by other machines.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="entloom-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


class Store:
    """Tables of one operator call under a folder of their own.

    A result that is still to be read needs its tables, so what an operator doesn't
    drop itself goes when the program ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._forget)

    def _forget(self) -> None:
        with contextlib.suppress(Exception):  # of a session that has ended before
            self.drop()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
