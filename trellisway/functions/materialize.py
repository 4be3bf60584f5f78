"""Intermediate tables that are written once, to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_written: ContextVar[list[str] | None] = ContextVar("_written", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the one that the session names in spark.checkpoint.dir. Where none is named, a new one in
    local mode, and an error on a cluster, whose executors share no folder that could be guessed."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of `df`, computed now and kept as a table in the shared folder; lineage and plan end there.

    A table and not checkpoint(): that hands its plan's constraints on, and loops make these grow without end. The table
    stays until discard() or, inside temporary_tables(), until that is left."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if (paths := _written.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored inside are deleted at its end; results that read them have to be written before."""
    paths: list[str] = []
    before = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(before)
        for path in paths:
            drop_folder(spark, path)


def discard(*tables: DataFrame | None) -> None:
    """Delete tables that stored() wrote and that no later step reads."""
    for df in tables:
        if df is not None and (files := df.inputFiles()):
            drop_folder(df.sparkSession, files[0].rsplit("/", 1)[0])


def _system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def drop_folder(spark: SparkSession, path: str) -> None:
    system, target = _system(spark, path)
    system.delete(target, True)


def drop_parts(spark: SparkSession, path: str, column: str, below: int) -> None:
    """Delete a table's parts whose whole number in the partition column is below a bound."""
    system, target = _system(spark, path)
    if system.exists(target):
        for status in system.listStatus(target):
            name = status.getPath().getName()
            if name.startswith(f"{column}=") and int(name.split("=")[1]) < below:
                system.delete(status.getPath(), True)
