"""Preparation of edge streams: loops, time origin, canonical pairs, checkpoints."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    """Lengths in the data's time unit. By default there are 50 checkpoints in a window."""

    window: int
    step: int

    @staticmethod
    def of(length: float, time_unit: float, per_window: int = 50) -> WindowSpec:
        window = int(length * time_unit)
        return WindowSpec(window, window // per_window)


def mean_time_span(edges: DataFrame) -> float:
    """The average time between arrivals: a unit to give window lengths in edges."""
    low, high, n = edges.agg(F.min("t"), F.max("t"), F.count(F.lit(1))).first()
    return (high - low) / n if n else 0.0


def drop_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("s <> d")


def rebase_time(edges: DataFrame) -> DataFrame:
    """Times since the first edge, which is found while the plan is made: one number."""
    return edges.withColumn("t", F.col("t") - F.lit(edges.agg(F.min("t")).first()[0]).cast("long"))


def canonicalize(edges: DataFrame, directed: bool = False) -> DataFrame:
    """The larger id first; of directed edges only where both ways are meant."""
    turn = F.col("bi") if directed else F.lit(True)
    return edges.withColumns({"s": F.when(turn, F.greatest("s", "d")).otherwise(F.col("s")), "d": F.when(turn, F.least("s", "d")).otherwise(F.col("d"))})


def with_arrival(edges: DataFrame) -> DataFrame:
    """The arrival key, which orders edges of one time by their id."""
    return edges.withColumn("arrival", F.struct("t", "eid"))


def prepared(edges: DataFrame, directed: bool = False) -> DataFrame:
    return canonicalize(rebase_time(drop_self_loops(edges)), directed)


def checkpoints(edges: DataFrame, step: int) -> DataFrame:
    """(cp, bucket, cp_t, cp_eid): the first arrival of every step from the first full one on; empty steps give none.

    The rows are as many as the steps of the data's time, and are numbered in one partition."""
    # the least id of each time first: whole numbers are held by hash, while structs have all edges sorted
    times = edges.where(F.col("t") >= step).groupBy(F.expr(f"t div {step}").alias("bucket"), "t").agg(F.min("eid").alias("eid"))
    firsts = times.groupBy("bucket").agg(F.min(F.struct("t", "eid")).alias("first"))
    return firsts.select(F.row_number().over(Window.orderBy("bucket")).cast("long").alias("cp"), "bucket", F.col("first.t").alias("cp_t"), F.col("first.eid").alias("cp_eid"))
