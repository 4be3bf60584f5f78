"""Streams whose state is a sample: stateless, keyed, and as tables of micro-batches in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trellisway.functions.materialize import drop_folder, stored
from trellisway.operators.estimators import chances, life_events, now_index, slice_index, sliced, swtc_from_states, weighed_arrivals, weighed_expiries
from trellisway.operators.prepare import WindowSpec, checkpoints
from trellisway.operators.sampling import KNOWN, SampleSpec, assign_slots, bernoulli_edges, dated_records, first_of_times, lives_of, records_of, replicate, slice_of, slice_start_sql, states_at
from trellisway.streaming.batches import keep_row, kept_row, new_folder, run_in_order


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run_through(stream: DataFrame, spark: SparkSession, mode: str = "append", conf: dict[str, str] | None = None) -> DataFrame:
    """All rows that a stream gives for what its source holds now, through files. `conf` holds for this query alone."""
    folder = new_folder(spark, "stream")
    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    for k, v in before.items():  # a started query has its own copy
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def stream_bernoulli(stream: DataFrame, p: float, seed: int) -> DataFrame:
    """The fixed-probability sample of a stream: a filter without state."""
    return bernoulli_edges(stream.withColumn("seed", F.lit(seed)), p)


def stream_window_stats(stream: DataFrame, window: str, step: str, late: str) -> DataFrame:
    """Instances in windows of event time that Spark aligns and leaves open at the end; so not the window of a checkpoint.
    Needs the time as a column `ts`; rows later than `late` are dropped."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", window, step).alias("w")).agg(F.count(F.lit(1)).alias("instances")).select(F.col("w.start").alias("from_ts"), F.col("w.end").alias("to_ts"), "instances")


_EDGE = ["priority", "t", "eid", "s", "d"]


def stream_priority_sample(stream: DataFrame, spec: SampleSpec, seed: int) -> DataFrame:
    """The bounded sample as a stream's state: a place keeps the tops of two slices. Gives a place's state after each
    batch that changes it: (grp, slot, slice, a_*, b_*, last_t, last_eid)."""
    columns = [f"{x}_{c}" for x in ("a", "b") for c in _EDGE]
    state = "slice long, " + ", ".join(f"{c} long" for c in columns)
    slotted = assign_slots(stream.withColumn("seed", F.lit(seed)), spec)

    def keep(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        """Of each slice only the highest priority counts, the later arrival if equal; of slices the last two."""
        slice_, *rest = held.get if held.exists else (None, *[None] * len(columns))
        tops = {} if slice_ is None else {slice_ - 1: rest[: len(_EDGE)], slice_: rest[len(_EDGE) :]}
        last = (-1, -1)
        for rows in batches:
            highest = rows.sort_values(_EDGE[:3]).drop_duplicates("slice", keep="last").nlargest(2, "slice")
            for now, *edge in highest[["slice", *_EDGE]].astype("int64").itertuples(index=False, name=None):
                tops[now] = max((x for x in (tops.get(now), edge) if x is not None and x[0] is not None), key=lambda x: x[:3])
            newest = rows.nlargest(1, ["t", "eid"]).iloc[0]
            last = max(last, (int(newest["t"]), int(newest["eid"])))
        slice_ = max(tops)
        a, b = tops.get(slice_ - 1, [None] * len(_EDGE)), tops[slice_]
        held.update((slice_, *a, *b))
        values: list[Any] = [key[0], key[1], slice_, *a, *b, *last]
        yield pd.DataFrame([values], columns=["grp", "slot", "slice", *columns, "last_t", "last_eid"]).astype("Int64")

    out = "grp long, slot long, " + state + ", last_t long, last_eid long"
    return slotted.groupBy("grp", "slot").applyInPandasWithState(keep, out, state, "append", GroupStateTimeout.NoTimeout)


def sample_from_states(states: DataFrame, now: int, spec: SampleSpec) -> DataFrame:
    """(grp, slot, t, eid, s, d): the valid edges at time `now`, from each place's last state."""
    latest = states.groupBy("grp", "slot").agg(F.max(F.struct("last_t", "last_eid", *[c for c in states.columns if c not in ("grp", "slot", "last_t", "last_eid")])).alias("x")).select("grp", "slot", "x.*")
    current = F.expr(f"({now} - {slice_start_sql('grp', spec)}) div {spec.window}")
    edge = lambda x: F.when(F.col(f"{x}_t").isNotNull(), F.struct(*[F.col(f"{x}_{c}").alias(c) for c in _EDGE]))
    a = F.when(current == F.col("slice"), edge("a")).when(current == F.col("slice") + 1, edge("b"))
    b = F.when(current == F.col("slice"), edge("b"))
    tops = latest.select("grp", "slot", a.alias("a"), b.alias("b"))
    valid = F.when(F.col("a").isNull() | (F.col("b")["priority"] >= F.col("a")["priority"]), F.col("b")).when(F.col("a")["t"] >= now - spec.window, F.col("a"))
    return tops.withColumn("edge", valid).where("edge IS NOT NULL").select("grp", "slot", "edge.t", "edge.eid", "edge.s", "edge.d")


_LAST = "bucket long, t long"
_PLACE = ["seed", "grp", "slot"]
_TOPS = ["slice", "priority", "t", "eid", "s", "d"]


def new_points(edges: DataFrame, step: int, given: int) -> DataFrame:
    """The checkpoints of buckets after `given`; edges before these are left out."""
    return checkpoints(edges.where(F.expr(f"t div {step} > {given}")), step)


def stream_swtc_estimate(stream: DataFrame, wspec: WindowSpec, spec: SampleSpec, seeds: int, folder: str, late: int | None = None) -> StreamingQuery:
    """Starts a query that keeps the sample alone, at most two edges for each place and seed, and gives the estimate at each
    checkpoint that a batch reaches, to `folder`/estimates as (seed, bucket, estimate). Order and lateness are those of
    run_in_order: edges that may still be overtaken are held back, and a checkpoint is given once it can't change."""

    def step(spark: SparkSession, edges: DataFrame, number: int) -> None:
        last = kept_row(spark, f"{folder}/last", _LAST, number) or (-1, 0)
        slotted = assign_slots(replicate(edges, seeds), spec).select(*_PLACE, *_TOPS)
        held = spark.read.schema(slotted.schema).parquet(f"{folder}/sample/{number - 1}") if number else None
        points = stored(new_points(edges, wspec.step, last[0]))
        rows = stored(slotted if held is None else held.unionByName(slotted))
        every = points.crossJoin(F.broadcast(spark.range(seeds).select(F.col("id").cast("int").alias("seed"))))
        found = swtc_from_states(states_at(rows, points, wspec, spec, ["s", "d"]), every, spec)
        found.join(points.select("cp", "bucket"), "cp").select("seed", "bucket", "estimate").write.mode("overwrite").parquet(f"{folder}/estimates/batch={number}")
        top = points.agg(F.max("bucket")).first()[0]
        newest = max(rows.agg(F.max("t")).first()[0] or 0, last[1])
        tops = rows.groupBy(*_PLACE, "slice").agg(F.max(F.struct(*_TOPS[1:])).alias("top")).select(*_PLACE, "slice", "top.*")
        tops.where(F.col("slice") >= slice_of(f"{newest}", "grp", spec) - 1).write.mode("overwrite").parquet(f"{folder}/sample/{number}")
        drop_folder(spark, f"{folder}/sample/{number - 2}")
        keep_row(spark, f"{folder}/last", _LAST, number, (last[0] if top is None else top, newest))

    return run_in_order(stream, step, folder, late)


_TOTALS = "seed int, grp long, valid long, q double, occ long"
_SLICES = "seed int, type int, slice long, w double"
_EXPIRED = "seed int, type int, now long, w double"
_RECORD = "seed int, grp long, slot long, slice long, priority long, t long, eid long, s long, d long, " + KNOWN


def stream_cbs_estimate(stream: DataFrame, wspec: WindowSpec, spec: SampleSpec, seeds: int, folder: str, slices: int = 10, late: int | None = None) -> StreamingQuery:
    """Starts a query that counts triangles as edges arrive and gives the estimate at each checkpoint that a batch reaches,
    to `folder`/estimates as (seed, bucket, estimate). Order and lateness are those of run_in_order.

    Between batches there are the records of each place's last two slices, from which the lives of sampled edges go on; the
    groups' totals (valid places, their part of q, occupied places); and for each seed a ring of slices + 1 counters of
    triangles by their oldest edge and the counter of what the current slice's expiries took. The batch's events are summed
    on from the totals, so its work follows its own edges and the sample."""
    length, keep = wspec.window // slices, ["s", "d"]
    tables = {"records": _RECORD, "totals": _TOTALS, "slices": _SLICES, "expired": _EXPIRED}

    def step(spark: SparkSession, edges: DataFrame, number: int) -> None:
        before = {k: spark.read.schema(v).parquet(f"{folder}/{k}/{number - 1}") if number else spark.createDataFrame([], v) for k, v in tables.items()}
        bucket, top_t, top_eid = kept_row(spark, f"{folder}/last", "bucket long, t long, eid long", number) or (-1, -1, -1)
        seeded = stored(replicate(edges, seeds))
        now = max((top_t, top_eid), tuple(seeded.agg(F.max(F.struct("t", "eid"))).first()[0] or (-1, -1)))
        times = first_of_times(edges)
        dated = stored(dated_records(records_of(assign_slots(seeded, spec), keep), times, spec, keep, before["records"]))
        lives = stored(lives_of(dated, spec, keep))
        since = f"at > struct({top_t}L, {top_eid}L)"
        # what earlier batches have counted is in the totals, which come first of all
        events = stored(life_events(dated, times, lives, spec).where(since))
        start = F.struct(F.lit(-2).cast("long").alias("t"), F.lit(-2).cast("long").alias("eid"))
        carried = before["totals"].select("seed", start.alias("at"), F.lit(1).alias("kind"), start.alias("by"), "grp", "valid", "q", "occ")
        sized = stored(chances(seeded, events.unionByName(carried), spec))
        added = stored(weighed_arrivals(seeded, lives, sized, wspec.window, False, [-1]))
        taken = stored(weighed_expiries(lives, sized, wspec.window, length, False, [-1], since))
        points = stored(new_points(edges, wspec.step, bucket))
        graphs = points.crossJoin(F.broadcast(spark.range(seeds).select(F.col("id").cast("int").alias("seed"))))
        found = sliced(added, taken, graphs, wspec, length, slices, [-1], (before["slices"], before["expired"]))
        found.join(points.select("cp", "bucket"), "cp").select("seed", "bucket", "estimate").write.mode("overwrite").parquet(f"{folder}/estimates/batch={number}")
        totals = events.select("seed", "grp", "valid", "q", "occ").unionByName(before["totals"]).groupBy("seed", "grp").agg(F.sum("valid").alias("valid"), F.sum("q").alias("q"), F.sum("occ").alias("occ"))
        index = now_index(f"{now[0]}L", length)
        ring = added.select("seed", "type", slice_index("oldest", length).alias("slice"), "w").unionByName(before["slices"]).where(F.col("slice") >= index - slices).groupBy("seed", "type", "slice").agg(F.sum("w").alias("w"))
        out = taken.select("seed", "type", now_index("at.t", length).alias("now"), "w").unionByName(before["expired"]).where(F.col("now") >= index).groupBy("seed", "type", "now").agg(F.sum("w").alias("w"))
        last_two = dated.where(F.col("slice") >= slice_of(f"{now[0]}L", "grp", spec) - 1) if now[0] >= 0 else dated
        for name, rows in {"records": last_two, "totals": totals, "slices": ring, "expired": out}.items():
            rows.select(*before[name].columns).write.mode("overwrite").parquet(f"{folder}/{name}/{number}")
            drop_folder(spark, f"{folder}/{name}/{number - 2}")
        top = points.agg(F.max("bucket")).first()[0]
        keep_row(spark, f"{folder}/last", "bucket long, t long, eid long", number, (bucket if top is None else top, *now))

    return run_in_order(stream, step, folder, late)
