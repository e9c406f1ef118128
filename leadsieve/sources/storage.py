"""Shared storage for intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session may go without: it gets a temporary folder. On a cluster a
    folder of one machine would be lost or unseen by the others.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="leadsieve-"))
    return context.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nobody else uses."""
    inside = _scope.get() or shared_dir(spark).rstrip("/")
    return f"{inside}/leadsieve-{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """What is settled inside goes to one folder, which is deleted at the end.

    Results must be written or collected before the scope ends. Scopes may be nested.
    """
    folder = scratch_path(spark, "scope")
    token = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(token)
        delete(spark, folder.rsplit("/", 1)[0])


def _opened(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, folder: str) -> bool:
    files, path = _opened(spark, folder)
    return files.exists(path)


def children(spark: SparkSession, folder: str) -> list[str]:
    """Names in ``folder``; none if it does not exist."""
    files, path = _opened(spark, folder)
    return [f.getPath().getName() for f in files.listStatus(path)] if files.exists(path) else []


def delete(spark: SparkSession, folder: str) -> None:
    files, path = _opened(spark, folder)
    files.delete(path, True)


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` computed once and kept as Parquet in the shared folder.

    Survives lost executors, and whoever reads it reads only the columns it needs.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder; survives lost executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
