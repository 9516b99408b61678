"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir`` and reading it
back, so a lost executor costs a re-read and never a recomputation of the past.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
_SCOPES: list[list[str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the session: ``spark.checkpoint.dir``, else the one that was set on the context.

    Where neither is there, a session on this machine alone gets a temporary folder; a cluster has to name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="intronaut-")
    return _LOCAL[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder of this application's tables."""
    path = f"{scratch_root(spark)}/intronaut/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear_scratch(spark: SparkSession) -> None:
    """Delete all tables of this application; frames that read them can't be used any more."""
    _delete(spark, f"{scratch_root(spark)}/intronaut/{spark.sparkContext.applicationId}")


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are deleted at the end: results have to be written elsewhere before."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            _delete(spark, path)


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return it as read back."""
    path = scratch_path(df.sparkSession, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
