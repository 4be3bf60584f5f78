"""Edge samples: fixed probability, and the bounded priority sample.

The priority sample has `groups` x `slots` places. Each arrival draws a place and a
priority; each group's time is cut into slices of one window length, staggered between
groups. At any time a place holds at most one valid edge, which follows from two maxima: A,
the highest priority of the slice before, and B, that of the current slice so far. So the
sample at a checkpoint is an aggregate, and its history is a comparison of records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisway.functions.materialize import stored
from trellisway.functions.mix import MODULUS, draw, rho_sql
from trellisway.operators.prepare import WindowSpec, checkpoints


@dataclass(frozen=True)
class SampleSpec:
    """Places in `groups` groups of `slots`; total size groups * slots."""

    window: int
    groups: int
    slots: int

    @staticmethod
    def of(length: float, rate: float, groups: int = 10, time_unit: float = 1.0) -> SampleSpec:
        """A sample of `rate` of the edges of a window of `length` edges, where time_unit is the time between two of them."""
        return SampleSpec(int(length * time_unit), groups, int(length * rate) // groups)

    @property
    def alpha(self) -> float:
        return 0.7213 / (1 + 1.079 / self.slots)


def replicate(edges: DataFrame, seeds: int, offset: int = 0) -> DataFrame:
    """All seeds in one job: a column `seed` with offset .. offset + seeds - 1."""
    return edges.withColumn("seed", F.explode(F.sequence(F.lit(offset), F.lit(offset + seeds - 1))))


def bernoulli_edges(edges: DataFrame, p: float, salt: int = 1) -> DataFrame:
    """Each edge with probability p, the same for every run; needs `eid` and `seed`."""
    return edges.where(sampled("seed", p, salt))


def sampled(seed: str | int, p: float, salt: int = 1) -> Column:
    """Whether an edge is among the bernoulli_edges of a seed."""
    return draw("eid", seed, salt) < int(p * MODULUS)


def slice_start_sql(group: str, spec: SampleSpec) -> str:
    """Where a group's slices begin: staggered below zero."""
    return f"(({group}) - {spec.groups}) * {spec.window // spec.groups}"


def slice_of(time: str, group: str, spec: SampleSpec) -> Column:
    """The number of the slice of `group` that a time at or after zero lies in."""
    return F.expr(f"({time} - {slice_start_sql(group, spec)}) div {spec.window}")


def assign_slots(edges: DataFrame, spec: SampleSpec) -> DataFrame:
    """Adds grp, slot, priority (an integer draw) and slice; needs eid, seed and t."""
    drawn = edges.withColumns({"priority": draw("eid", "seed", 2), "grp": F.pmod(draw("eid", "seed", 3), F.lit(spec.groups)), "slot": F.pmod(draw("eid", "seed", 4), F.lit(spec.slots))})
    return drawn.withColumn("slice", slice_of("t", "grp", spec))


def _ends(columns: list[str]) -> Column:
    return F.struct("priority", "t", "eid", *columns)


#: One edge of so many is looked at for bounds; all others are then held against these.
BOUND_BY = 8


def slots_at(slotted: DataFrame, points: DataFrame, spec: SampleSpec, step: int, keep: list[str]) -> DataFrame:
    """(seed, cp, cp_t, grp, slot, a, b) for every occupied place at every checkpoint; a and b are the two maxima.

    Edges of a place that become visible at the same step are one row before they are copied to the checkpoints
    of their own slice and the next. The checkpoints, and the bounds of each seed, group, slice and step, are broadcast."""
    at = F.broadcast(points.select(F.col("bucket").alias("own"), "cp_t", "cp_eid"))
    # places that can't be null: a filter on them would work all draws out anew, in code too long to be compiled
    placed = slotted.where("eid IS NOT NULL AND t IS NOT NULL").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("grp", "slot", "slice", "priority")})
    marked = placed.withColumn("own", F.expr(f"t div {step}")).join(at, "own", "left")
    # an edge that arrives in a step after its checkpoint is seen from the next step on
    first = F.when(F.expr("t < cp_t OR (t = cp_t AND eid <= cp_eid)"), F.col("own")).otherwise(F.col("own") + 1)
    marked = marked.withColumn("visible", F.coalesce(first, F.lit(0)))
    # an edge below the top of each of a group's places is the top of none; only the others are sorted, ties and all. The tops
    # of an eighth of the edges are no higher than those of all, so where these fill each place the least of them is a bound
    bound = ["seed", "grp", "slice", "visible"]
    highest = marked.where(f"pmod(xxhash64(eid), {BOUND_BY}) = 0").groupBy(*bound, "slot").agg(F.max("priority").alias("highest"))
    least = F.broadcast(highest.groupBy(*bound).agg(F.min("highest").alias("least"), F.count(F.lit(1)).alias("places")).where(f"places = {spec.slots}").drop("places"))
    tops = marked.join(least, bound, "left").where("least IS NULL OR priority >= least").groupBy("seed", "grp", "slot", "slice", "visible").agg(F.max(_ends(keep)).alias("top"))
    start = slice_start_sql("grp", spec)
    until = F.expr(f"({start} + {spec.window} * (slice + 2) - 1) div {step}")
    seen = tops.withColumn("bucket", F.explode(F.expr(f"sequence(visible, greatest(visible, ({start} + {spec.window} * (slice + 2) - 1) div {step}))"))).where(F.col("bucket") <= until).join(points.select("cp", "bucket", "cp_t"), "bucket")
    behind = slice_of("cp_t", "grp", spec) - F.col("slice")
    return seen.withColumn("behind", behind).where("behind IN (0, 1)").groupBy("seed", "cp", "cp_t", "grp", "slot").agg(F.max(F.when(F.col("behind") == 1, F.col("top"))).alias("a"), F.max(F.when(F.col("behind") == 0, F.col("top"))).alias("b"))


def slot_states(edges: DataFrame, wspec: WindowSpec, spec: SampleSpec, keep: list[str] | None = None, points: DataFrame | None = None) -> DataFrame:
    """(seed, cp, cp_t, grp, slot, edge, top): the valid edge of each occupied place, null if it has none, and the
    highest priority in it. Stores the checkpoints, if they are not given as `points`."""
    points = stored(checkpoints(edges, wspec.step)) if points is None else points
    return states_at(assign_slots(edges, spec), points, wspec, spec, ["s", "d"] if keep is None else keep)


def states_at(slotted: DataFrame, points: DataFrame, wspec: WindowSpec, spec: SampleSpec, keep: list[str]) -> DataFrame:
    """As slot_states, for edges that have their places and for these checkpoints."""
    both = slots_at(slotted, points, spec, wspec.step, keep)
    a, b = F.col("a"), F.col("b")
    edge = F.when(a.isNull() | (b["priority"] >= a["priority"]), b).when(a["t"] >= F.col("cp_t") - spec.window, a)
    return both.select("seed", "cp", "cp_t", "grp", "slot", edge.alias("edge"), F.greatest(a["priority"], b["priority"]).alias("top"))


def priority_sample_at(states: DataFrame) -> DataFrame:
    """(seed, cp, grp, slot, t, eid, ...): the valid edges."""
    return states.where("edge IS NOT NULL").select("seed", "cp", "grp", "slot", "edge.*")


def group_estimate_sql(valid: str, q: str, occupied: str, spec: SampleSpec) -> str:
    """A group's share of the window's edge number. q: the sum of 2^-rho over places, 1 for empty ones."""
    m, alpha = spec.slots, spec.alpha
    first = f"({alpha!r}D * {m * m} / ({q}))"
    linear = f"(-ln(1 - cast({occupied} AS double) / {m}) * {m})"
    card = f"CASE WHEN {first} < {2.5 * m!r}D AND {occupied} < {m} THEN {linear} ELSE {first} END"
    return f"CASE WHEN {occupied} > 0 THEN ({card}) * {valid} / {occupied} ELSE 0D END"


def edge_cardinality_estimate(states: DataFrame, spec: SampleSpec) -> DataFrame:
    """(seed, cp, n, edges): valid places, and the estimated number of edges in the window."""
    groups = states.groupBy("seed", "cp", "grp").agg(F.count("edge").alias("valid"), F.count(F.lit(1)).alias("occ"), F.sum(F.expr(f"pow(2D, -{rho_sql('top')})")).alias("part"))
    each = groups.withColumn("card", F.expr(group_estimate_sql("valid", f"({spec.slots} - occ + part)", "occ", spec)))
    return each.groupBy("seed", "cp").agg(F.sum("valid").alias("n"), F.sum("card").alias("edges"))


def sample_size(states: DataFrame) -> DataFrame:
    return states.groupBy("seed", "cp").agg(F.count("edge").alias("n"))


def chunk_length(window: int) -> int:
    """The length of the chunks of time that are sorted whole."""
    return max(1, window // 32)


def first_arrivals(times: DataFrame, asked: DataFrame, chunk: int) -> DataFrame:
    """(x, at): the first arrival (struct t, eid) at or after each asked time x; null if there is none. times: (t, eid), the
    first arrival of each time. Sorted inside chunks of time; only a table of one row a chunk is looked through whole."""
    from_edges = times.select(F.col("t").alias("pos"), F.lit(1).alias("kind"), F.struct("t", "eid").alias("at"))
    rows = asked.select(F.col("x").alias("pos"), F.lit(0).alias("kind")).distinct().unionByName(from_edges, allowMissingColumns=True)
    rows = rows.withColumn("chunk", F.floor(F.col("pos") / chunk))
    # latest first, so that the frame grows from row to row; one that shrinks would be read anew for each row
    ahead = Window.partitionBy("chunk").orderBy(F.desc("pos"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumn("near", F.last("at", ignorenulls=True).over(ahead)).where("kind = 0")
    firsts = rows.groupBy("chunk").agg(F.min("at").alias("own"))
    later = firsts.select("chunk", F.last("own", ignorenulls=True).over(Window.orderBy(F.desc("chunk")).rowsBetween(Window.unboundedPreceding, -1)).alias("later"))
    return inside.join(later, "chunk").select(F.col("pos").alias("x"), F.coalesce("near", "later").alias("at"))


PLACE = ["seed", "grp", "slot", "slice"]


def records_of(slotted: DataFrame, keep: list[str]) -> DataFrame:
    """The edges with no higher priority before them in their place and slice."""
    order = Window.partitionBy(*PLACE).orderBy("t", "eid").rowsBetween(Window.unboundedPreceding, -1)
    return slotted.withColumn("before", F.max("priority").over(order)).where("before IS NULL OR priority >= before").select(*PLACE, "priority", "t", "eid", *keep)


#: What is known of a record for good once it is: the highest priority of the slice before, and the arrivals at which the
#: next slice began and at which the record was out of the window.
KNOWN = "top_before long, switch struct<t: bigint, eid: bigint>, expiry struct<t: bigint, eid: bigint>"


def dated_records(records: DataFrame, times: DataFrame, spec: SampleSpec, keep: list[str], earlier: DataFrame | None = None) -> DataFrame:
    """Records with arrival, next_record (in place and slice), beaten_at (by one of the next slice) and KNOWN; all but
    top_before are arrivals (struct t, eid), null if there is none so far. Stores tables.

    times: (t, eid) of the first arrival of each time. Of a stream these and `records` may be those since some moment, if
    `earlier` has, with KNOWN, the records of the slices that were the last two of their groups then."""
    columns = [*PLACE, "priority", "t", "eid", *keep]
    rows = records.select(*columns, *[F.lit(None).cast(k.split(" ", 1)[1].strip()).alias(k.split(" ", 1)[0]) for k in ("top_before long", *_STRUCTS)])
    if earlier is not None:
        # what is a record among its own may be below one of before
        top = earlier.groupBy(*PLACE).agg(F.max("priority").alias("old"))
        rows = rows.join(top, PLACE, "left").where("old IS NULL OR priority >= old").drop("old").unionByName(earlier.select(*rows.columns))
    order = Window.partitionBy(*PLACE).orderBy("t", "eid")
    rows = stored(rows.withColumn("arrival", F.struct("t", "eid")).withColumn("next_record", F.lead("arrival").over(order)))
    place = PLACE[:-1]
    tops = rows.where("next_record IS NULL").select(*place, (F.col("slice") + 1).alias("slice"), F.col("priority").alias("top"))
    # records of the next slice are what can replace: of them, the first with at least the own priority
    following = rows.select(*place, (F.col("slice") - 1).alias("slice"), F.col("priority").alias("next_priority"), F.col("arrival").alias("next_arrival"))
    beaten = rows.select(*PLACE, "priority", "arrival").join(following, PLACE).where("next_priority >= priority").groupBy(*PLACE, "arrival").agg(F.min("next_arrival").alias("beaten_at"))
    switch_x, expire_x = F.expr(f"{slice_start_sql('grp', spec)} + {spec.window} * (slice + 1)"), F.col("t") + spec.window + 1
    asked = rows.where("switch IS NULL").select(switch_x.alias("x")).unionByName(rows.where("expiry IS NULL").select(expire_x.alias("x")))
    found = stored(first_arrivals(times, asked, chunk_length(spec.window)))
    of = lambda x, at: found.select(F.col("x").alias(x), F.col("at").alias(at))
    rows = rows.withColumns({"switch_x": switch_x, "expire_x": expire_x}).join(tops, PLACE, "left").join(beaten, [*PLACE, "arrival"], "left").join(of("switch_x", "new_switch"), "switch_x", "left").join(of("expire_x", "new_expiry"), "expire_x", "left")
    return rows.select(*columns, "arrival", "next_record", "beaten_at", F.coalesce("top_before", "top").alias("top_before"), F.coalesce("switch", "new_switch").alias("switch"), F.coalesce("expiry", "new_expiry").alias("expiry"))


_STRUCTS = [f"{c} struct<t: bigint, eid: bigint>" for c in ("switch", "expiry")]


def lives_of(dated: DataFrame, spec: SampleSpec, keep: list[str]) -> DataFrame:
    """As sample_lifetimes, of dated records."""
    own = F.col("top_before").isNull() | (F.col("priority") >= F.col("top_before"))
    promoted = F.col("next_record").isNull() & F.col("switch").isNotNull() & (F.col("t") >= F.col("switch")["t"] - spec.window)
    start = F.when(own, F.col("arrival")).when(promoted, F.col("switch"))
    end = F.least("next_record", "beaten_at", "expiry")
    out = dated.withColumns({"start": start, "end": end}).where(F.col("start").isNotNull() & (F.col("end").isNull() | (F.col("end") > F.col("start"))))
    return out.withColumns({"expired": F.coalesce(F.col("expiry") <= F.col("end"), F.lit(False)), "promoted": ~own}).select(*PLACE, "priority", "t", "eid", *keep, "start", "end", "expired", "promoted")


def first_of_times(edges: DataFrame) -> DataFrame:
    return edges.groupBy("t").agg(F.min("eid").alias("eid"))


def sample_lifetimes(edges: DataFrame, spec: SampleSpec, keep: list[str] | None = None) -> DataFrame:
    """(seed, grp, slot, slice, priority, t, eid, ..., start, end, expired): when each edge that is ever valid is so.

    start and end are arrivals (struct t, eid), the end excluded; end is null while it lasts; expired tells ends by time
    from replacements. A record is an edge with no higher priority before it in its place and slice. Stores tables."""
    keep = ["s", "d"] if keep is None else keep
    records = records_of(assign_slots(edges, spec), keep)
    return lives_of(dated_records(records, first_of_times(edges), spec, keep), spec, keep)
