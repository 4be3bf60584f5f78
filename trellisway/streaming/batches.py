"""Micro-batches in order of arrival, over tables of the shared folder.

A job is a function of the edges that a batch releases. It reads what batches before it have written and writes under its
own number alone, so a batch may run again after a failure."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trellisway.functions.materialize import drop_folder, shared_folder, stored, temporary_tables
from trellisway.sources.edges import numbered

EDGE = "eid long, t long, s long, d long"
_MARK = "t long, eid long, next_eid long, dropped long"


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_part(df: DataFrame, path: str, *parts: str) -> None:
    """Replace only those parts of a table that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def keep_row(spark: SparkSession, path: str, schema: str, number: int, row: tuple) -> None:
    """The state of a batch that is a row; that of the batch before stays for a second run, older ones go."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/{number}")
    drop_folder(spark, f"{path}/{number - 2}")


def kept_row(spark: SparkSession, path: str, schema: str, number: int):
    """The row that the batch before has left; null before the first."""
    return spark.read.schema(schema).parquet(f"{path}/{number - 1}").first() if number else None


def run_in_order(stream: DataFrame, step: Callable[[SparkSession, DataFrame, int], None], folder: str, late: int | None = None) -> StreamingQuery:
    """Starts a query that calls step(spark, edges, number) with the edges of each batch in order of arrival: each edge
    after all that are before it in (t, eid) and were given to earlier calls.

    Without `late` the stream has to be in order, and edges before the newest of earlier batches are dropped. With it edges
    may be late by so much time against that edge; a batch holds back what could still be overtaken, as a table. How many
    were dropped is in dropped_edges(). Edges without eid (of read_edge_stream) are numbered as they come."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        with temporary_tables(spark):
            mark = kept_row(spark, f"{folder}/mark", _MARK, number) or (-1, -1, 0, 0)
            rows = batch if "eid" in batch.columns else numbered(batch, mark[2])
            in_time = F.struct("t", "eid") > F.struct(F.lit(mark[0]).cast("long"), F.lit(mark[1]).cast("long")) if late is None else F.col("t") >= mark[0] - late
            # the source is read once
            came = stored(rows.select("eid", "t", "s", "d", in_time.alias("in_time")))
            edges = came.where("in_time").drop("in_time")
            top, last_id, lost = came.agg(F.max(F.when(F.col("in_time"), F.struct("t", "eid"))), F.max("eid"), F.count_if(~F.col("in_time"))).first()
            newest = max((mark[0], mark[1]), (-1, -1) if top is None else tuple(top))
            if late is not None:
                if number:
                    edges = edges.unionByName(spark.read.schema(EDGE).parquet(f"{folder}/held/{number - 1}"))
                edges = stored(edges)
                edges.where(F.col("t") >= newest[0] - late).write.mode("overwrite").parquet(f"{folder}/held/{number}")
                drop_folder(spark, f"{folder}/held/{number - 2}")
                edges = edges.where(F.col("t") < newest[0] - late)
            step(spark, edges, number)
            keep_row(spark, f"{folder}/mark", _MARK, number, (*newest, mark[2] if last_id is None else last_id + 1, mark[3] + lost))

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()


def dropped_edges(spark: SparkSession, folder: str) -> int:
    """How many edges came too late so far, once a batch has run."""
    return spark.read.option("recursiveFileLookup", True).schema(_MARK).parquet(f"{folder}/mark").agg(F.max("dropped")).first()[0]
