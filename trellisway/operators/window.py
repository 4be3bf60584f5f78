"""The window's graph at every checkpoint.

An edge is in the window of checkpoint (T, tie) if it has arrived by then and its time is at
least T - window: closed at both ends. The steps at which an edge may be seen follow from its
time alone, so edges are copied to those and joined with the checkpoints on the step."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisway.functions.materialize import stored
from trellisway.operators.prepare import WindowSpec, checkpoints


def window_edges(edges: DataFrame, spec: WindowSpec) -> DataFrame:
    """Every edge at every checkpoint whose window holds it: cp, cp_t and the edge's columns."""
    steps = F.sequence(F.expr(f"t div {spec.step}"), F.expr(f"(t + {spec.window}) div {spec.step}"))
    seen = edges.withColumn("bucket", F.explode(steps)).join(checkpoints(edges, spec.step), "bucket")
    arrived = (F.col("t") < F.col("cp_t")) | ((F.col("t") == F.col("cp_t")) & (F.col("eid") <= F.col("cp_eid")))
    return seen.where(arrived & (F.col("t") >= F.col("cp_t") - spec.window)).drop("bucket", "cp_eid")


def edge_frequencies(window: DataFrame, by: list[str], directed: bool = False) -> DataFrame:
    """How often each pair occurs; summed before anything is joined."""
    pair = ["s", "d", *["bi"] * directed]
    return window.groupBy(*by, *pair).agg(F.count(F.lit(1)).alias("f"))


def distinct_edge_count(frequencies: DataFrame, by: list[str]) -> DataFrame:
    return frequencies.groupBy(*by).agg(F.count(F.lit(1)).alias("distinct_edges"))


def edge_instance_count(window: DataFrame, by: list[str]) -> DataFrame:
    return window.groupBy(*by).agg(F.count(F.lit(1)).alias("instances"))


def node_count(frequencies: DataFrame, by: list[str]) -> DataFrame:
    """Endpoints of either side, also for undirected edges."""
    ends = frequencies.select(*by, F.explode(F.array("s", "d")).alias("node")).distinct()
    return ends.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))


def seen_from(rows: DataFrame, edges: DataFrame, points: DataFrame, spec: WindowSpec, last: str, first: str) -> DataFrame:
    """The checkpoint numbers [cp_from, cp_to] at which a thing is alive: from the arrival `last` (struct t, eid) on, while
    the time `first` is in the window. Both are arrivals of `edges`; the tables of steps have a row for each step in which
    one of these or a checkpoint lies, and are looked through in one partition as the checkpoints are."""
    starts, ends = (edges.select(F.expr(f"(t + {lag}) div {spec.step}").alias("step")) for lag in (0, spec.window))
    steps = starts.unionByName(ends).distinct().join(points, F.col("step") == F.col("bucket"), "full").withColumn("step", F.coalesce("step", "bucket"))
    after, before = (Window.orderBy(by).rowsBetween(Window.unboundedPreceding, 0) for by in (F.desc("step"), "step"))
    table = stored(steps.select("step", "cp", "cp_t", "cp_eid", F.last("cp", ignorenulls=True).over(after).alias("at_or_after"), F.last("cp", ignorenulls=True).over(before).alias("at_or_before")))
    f = table.select(F.col("step").alias("f_step"), F.col("cp_t").alias("f_t"), F.col("cp_eid").alias("f_eid"), F.col("at_or_after").alias("f_next"), F.col("cp").alias("f_cp"))
    g = table.select(F.col("step").alias("g_step"), F.col("cp_t").alias("g_t"), F.col("at_or_before").alias("g_last"), F.col("cp").alias("g_cp"))
    out = rows.join(f, F.expr(f"{last}.t div {spec.step}") == F.col("f_step")).join(g, F.expr(f"({first} + {spec.window}) div {spec.step}") == F.col("g_step"))
    on_it = F.expr(f"f_cp IS NULL OR {last}.t < f_t OR ({last}.t = f_t AND {last}.eid <= f_eid)")
    cp_from = F.when(on_it, F.col("f_next")).otherwise(F.col("f_next") + 1)
    cp_to = F.when(F.expr(f"g_cp IS NOT NULL AND g_t > {first} + {spec.window}"), F.col("g_last") - 1).otherwise(F.col("g_last"))
    return out.withColumns({"cp_from": cp_from, "cp_to": cp_to}).where("cp_from <= cp_to").drop("f_step", "f_t", "f_eid", "f_next", "f_cp", "g_step", "g_t", "g_last", "g_cp")
