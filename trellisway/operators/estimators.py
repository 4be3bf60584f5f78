"""Approximate triangle counts from edge samples.

Three families: fixed probability; counts inside a priority sample, scaled up at each
checkpoint; and counts on arrival, put into slices of time and corrected for expiry."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trellisway.functions.materialize import stored
from trellisway.functions.mix import rho_sql
from trellisway.operators.changes import counts_of_parts
from trellisway.operators.changes import triangle_count as triangle_count_by_changes
from trellisway.operators.directed import directed_triangle_count
from trellisway.operators.prepare import WindowSpec, checkpoints
from trellisway.operators.sampling import PLACE, SampleSpec, assign_slots, bernoulli_edges, chunk_length, dated_records, edge_cardinality_estimate, first_arrivals, first_of_times, group_estimate_sql, lives_of, priority_sample_at, records_of, sampled, slice_of, slice_start_sql, slot_states
from trellisway.operators.triangles import local_triangle_count, triangle_count
from trellisway.operators.window import edge_frequencies

_BY = ["seed", "cp"]


def _graphs(edges: DataFrame, points: DataFrame) -> DataFrame:
    """Every seed and checkpoint."""
    return points.crossJoin(F.broadcast(edges.select("seed").distinct()))


# ---------------------------------------------------------------- fixed probability


def fixed_p_estimate(edges: DataFrame, wspec: WindowSpec, p: float) -> DataFrame:
    """(seed, cp, estimate): weighted triangles among sampled edges / p^3. Needs `seed`."""
    counts = triangle_count_by_changes(bernoulli_edges(edges, p), wspec, weighted=True, by=["seed"], times=edges.select("t", "eid").distinct())
    return counts.select(*_BY, (F.col("triangles") / p**3).alias("estimate"))


def fixed_p_and_exact(edges: DataFrame, wspec: WindowSpec, p: float, seeds: int) -> DataFrame:
    """(seed, cp, estimate, triangles): fixed_p_estimate of the seeds 0 to seeds - 1, and the exact weighted count. Edges are
    not copied to seeds: an edge knows which samples it is in, and triangles are found once for all of them."""
    parts = {f"sampled_{k}": sampled(k, p).cast("int") for k in range(seeds)}
    counts = counts_of_parts(edges, wspec, parts)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("seed"), F.col(name).alias("n")) for k, name in enumerate(parts)]))
    return counts.select("cp", "triangles", each.alias("x")).select("x.seed", "cp", (F.col("x.n") / p**3).alias("estimate"), "triangles")


# ---------------------------------------------------------------- counts inside the priority sample


def triple_probability(sizes: DataFrame) -> DataFrame:
    """(seed, cp, n, edges, p): the chance that three edges of the window are all in the sample; null if it is too small."""
    n, e = F.col("n"), F.col("edges")
    return sizes.withColumn("p", F.when((n > 3) & (e > 3), n / e * (n - 1) / (e - 1) * (n - 2) / (e - 2)))


def _scaled(counts: DataFrame, sizes: DataFrame, keys: list[str]) -> DataFrame:
    estimate = F.coalesce(F.col("triangles") / F.col("p"), F.lit(0.0))
    return counts.join(triple_probability(sizes).select(*_BY, "p"), _BY, "left").select(*keys, estimate.alias("estimate"))


def swtc_estimate(edges: DataFrame, wspec: WindowSpec, spec: SampleSpec) -> DataFrame:
    """(seed, cp, estimate): weighted triangles in the sample over the triple's probability. Stores the checkpoints."""
    points = stored(checkpoints(edges, wspec.step))
    return swtc_from_states(slot_states(edges, wspec, spec, points=points), _graphs(edges, points), spec)


def swtc_from_states(states: DataFrame, every: DataFrame, spec: SampleSpec) -> DataFrame:
    """As swtc_estimate, from the sample's places; `every` lists the (seed, cp) to give."""
    counts = triangle_count(edge_frequencies(priority_sample_at(states), _BY), _BY, weighted=True, every=every)
    return _scaled(counts, edge_cardinality_estimate(states, spec), _BY)


def swtc_directed_estimate(edges: DataFrame, wspec: WindowSpec, spec: SampleSpec, types: list[int] | None = None) -> DataFrame:
    """(seed, cp, type, estimate). Stores the checkpoints."""
    points = stored(checkpoints(edges, wspec.step))
    states = slot_states(edges, wspec, spec, ["s", "d", "bi"], points)
    counts = directed_triangle_count(edge_frequencies(priority_sample_at(states), _BY, directed=True), _BY, True, types, every=_graphs(edges, points))
    return _scaled(counts, edge_cardinality_estimate(states, spec), [*_BY, "type"])


def swtc_local_estimate(edges: DataFrame, wspec: WindowSpec, spec: SampleSpec, node: int | None = None) -> DataFrame:
    """(seed, cp, node, estimate) of the sample's nodes; with `node` of that one at every checkpoint, 0 where the sample doesn't have it.
    Stores the checkpoints."""
    points = stored(checkpoints(edges, wspec.step))
    states = slot_states(edges, wspec, spec, points=points)
    counts = local_triangle_count(edge_frequencies(priority_sample_at(states), _BY), _BY, weighted=True)
    sizes = edge_cardinality_estimate(states, spec)
    if node is not None:
        one = counts.where(F.col("node") == node).drop("node")
        counts = _graphs(edges, points).select(*_BY).join(one, _BY, "left").withColumn("node", F.lit(node).cast("long"))
    return _scaled(counts, sizes, [*_BY, "node"])


# ---------------------------------------------------------------- counts on arrival

#: Which neighbours of s and d close a triangle of each type with an edge s->d (False) or s<->d (True).
CLOSINGS = {
    0: [(False, "out", "out"), (False, "out", "in"), (False, "in", "in")],
    1: [(False, "in", "out")],
    2: [(False, "bi", "out"), (False, "in", "bi"), (True, "out", "in"), (True, "in", "out")],
    3: [(False, "out", "bi"), (True, "in", "in")],
    4: [(False, "bi", "in"), (True, "out", "out")],
    5: [(False, "bi", "bi"), (True, "in", "bi"), (True, "bi", "in"), (True, "bi", "out"), (True, "out", "bi")],
    6: [(True, "bi", "bi")],
}


def slice_index(time: str, length: int):
    """Slices (i * length, (i + 1) * length]; time 0 is in slice -1."""
    return F.expr(f"cast(ceil({time} / {length}D) AS bigint) - 1")


def now_index(time: str, length: int):
    return F.greatest(slice_index(time, length), F.lit(0).cast("long"))


def _neighbour_lives(lives: DataFrame, window: int, directed: bool) -> DataFrame:
    """Sampled edges from either end, in every chunk of time in which they may be valid."""
    ends = F.array(F.struct(F.col("s").alias("node"), F.col("d").alias("other"), F.lit("s").alias("end")), F.struct(F.col("d").alias("node"), F.col("s").alias("other"), F.lit("d").alias("end")))
    kind = F.when(F.lit(not directed), F.lit("x")).when(F.col("bi"), F.lit("bi")).when(F.col("e.end") == "s", F.lit("out")).otherwise(F.lit("in")) if directed else F.lit("x")
    # an edge is valid until the first arrival that is more than a window later, which may be any time away
    until = F.coalesce(F.col("end")["t"], F.col("t") + window + 1)
    chunks = F.sequence(F.expr(f"start.t div {window}"), F.greatest(F.expr(f"start.t div {window}"), F.floor(until / window).cast("long")))
    return lives.withColumn("e", F.explode(ends)).select("seed", "e.node", "e.other", kind.alias("dir"), F.col("t").alias("life_t"), F.col("eid").alias("life_eid"), "start", "end", "expired", F.explode(chunks).alias("chunk"))


#: Paths through one node, in a chunk, that a task goes through.
PATHS = 1 << 20


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The equi-join of both sides. Keys with more than `most` pairs of rows are split: each of their left rows has one of
    several salts, and their right rows are copied to all of these; rows of other keys are not touched."""
    count = lambda df, n: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    salts = F.least(F.ceil(F.col("_l") * F.col("_r") / most), "_l").cast("int")
    hot = count(left, "_l").join(count(right, "_r"), keys).where(F.col("_l") * F.col("_r") > most).select(*keys, salts.alias("_salts"))
    given = F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    return left.join(hot, keys, "left").withColumn("_salt", given).drop("_salts").join(right.join(hot, keys, "left").withColumn("_salt", every).drop("_salts"), [*keys, "_salt"]).drop("_salt")


def _closed(points: DataFrame, lives: DataFrame, window: int, directed: bool, valid: str) -> DataFrame:
    """Pairs of neighbours of both ends of a point (seed, s, d, bi, at, ...) with the same other end, both valid at the
    point by the SQL condition `valid` on {f}: as f_* and g_* columns, and the type that they close."""
    ends = _neighbour_lives(lives, window, directed)
    kept = ("dir", "life_t", "life_eid", "start", "end", "expired")
    side = lambda x, c: ends.select("seed", "chunk", F.col("node").alias(c), F.col("other"), *[F.col(n).alias(f"{x}_{n}") for n in kept])
    degree = ends.groupBy("seed", "chunk", "node").agg(F.count(F.lit(1)).alias("degree"))
    at = lambda c: degree.select("seed", "chunk", F.col("node").alias(c), F.col("degree").alias(f"degree_{c}"))
    # both ends have neighbours or nothing is closed; those of the end with fewer are tried, so a hub costs what its partners have
    asked = points.withColumn("chunk", F.expr(f"at.t div {window}")).join(at("s"), ["seed", "chunk", "s"]).join(at("d"), ["seed", "chunk", "d"])
    turned = F.col("degree_d") < F.col("degree_s")
    asked = asked.withColumns({"near": F.when(turned, F.col("d")).otherwise(F.col("s")), "far": F.when(turned, F.col("s")).otherwise(F.col("d")), "turned": turned})
    one = salted_join(asked, side("p", "near"), ["seed", "chunk", "near"], PATHS).where(F.expr(valid.format(f="p")))
    two = one.join(side("q", "far"), ["seed", "chunk", "far", "other"]).where(F.expr(valid.format(f="q")))
    two = two.withColumns({f"{x}_{n}": F.when(F.col("turned"), F.col(f"{no}_{n}")).otherwise(F.col(f"{yes}_{n}")) for x, yes, no in (("f", "p", "q"), ("g", "q", "p")) for n in kept})
    if not directed:
        return two.withColumn("type", F.lit(-1))
    rules = points.sparkSession.createDataFrame([(bi, a, b, k) for k, rows in CLOSINGS.items() for bi, a, b in rows], "bi boolean, f_dir string, g_dir string, type int")
    return two.join(F.broadcast(rules), ["bi", "f_dir", "g_dir"])


def _points(rows: DataFrame, directed: bool) -> DataFrame:
    return rows if directed else rows.withColumn("bi", F.lit(False))


def arrival_triangles(edges: DataFrame, lives: DataFrame, window: int, directed: bool = False) -> DataFrame:
    """(seed, at, type, oldest): a row for each triangle that an arrival, sampled or not, closes with two sampled edges
    that are valid after its own insertion; oldest is the least of the three times."""
    points = _points(edges.withColumn("at", F.struct("t", "eid")), directed)
    found = _closed(points, lives, window, directed, "{f}_start <= at AND ({f}_end IS NULL OR {f}_end > at)")
    return found.select("seed", "at", "type", F.least("t", "f_life_t", "g_life_t").alias("oldest"))


def expired_triangles(lives: DataFrame, window: int, directed: bool = False, since: str = "true") -> DataFrame:
    """(seed, at, t, eid, type): of expiries `at` that the SQL condition `since` holds for, a row for each triangle of an expiring sampled edge with two that are still valid; a
    triangle whose edges expire on one arrival is that of its oldest edge."""
    gone = _points(lives.where("expired").withColumn("at", F.col("end")).select("seed", "s", "d", *["bi"] * directed, "t", "eid", "at").where(since), directed)
    still = "{f}_start < at AND ({f}_end IS NULL OR {f}_end > at OR ({f}_end = at AND (NOT {f}_expired OR struct({f}_life_t, {f}_life_eid) > struct(t, eid))))"
    return _closed(gone, lives, window, directed, still).select("seed", "at", "t", "eid", "type")


def life_events(dated: DataFrame, times: DataFrame, lives: DataFrame, spec: SampleSpec) -> DataFrame:
    """What changes the state of the groups: (seed, at, kind, by, grp, valid, q, occ) with changes of the three numbers.

    Order inside an arrival: kind 0 expiries, by (t, eid) of the edge; 1 slices of groups; 2 the insertion."""
    none = F.struct(F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("eid"))
    zero = F.lit(0).cast("long")
    begun = lives.select("seed", F.col("start").alias("at"), F.when(F.col("promoted"), 1).otherwise(2).alias("kind"), none.alias("by"), "grp", F.lit(1).cast("long").alias("valid"))
    ended = lives.where("end IS NOT NULL").select("seed", F.col("end").alias("at"), F.when(F.col("expired"), 0).otherwise(2).alias("kind"), F.when(F.col("expired"), F.struct("t", "eid")).otherwise(none).alias("by"), "grp", F.lit(-1).cast("long").alias("valid"))
    states = _occupancy_events(dated, times, spec).select("seed", "at", "kind", none.alias("by"), "grp", zero.alias("valid"), "q", "occ")
    lived = begun.unionByName(ended).withColumns({"q": F.lit(0.0), "occ": zero})
    return lived.unionByName(states)


def _occupancy_events(dated: DataFrame, times: DataFrame, spec: SampleSpec) -> DataFrame:
    """(seed, at, kind, grp, q, occ): changes of a place's part of q (1 while empty, else 2^-rho of its highest priority)
    and of its being occupied."""
    place = PLACE[:-1]
    tops = dated.where("next_record IS NULL").select(*PLACE, F.col("priority").alias("top"), F.col("switch").alias("at1"))
    rows = tops.withColumn("x2", F.expr(f"{slice_start_sql('grp', spec)} + {spec.window} * (slice + 2)"))
    found = stored(first_arrivals(times, rows.select(F.col("x2").alias("x")), chunk_length(spec.window)))
    rows = rows.join(found.select(F.col("x").alias("x2"), F.col("at").alias("at2")), "x2")
    after = tops.select(*place, (F.col("slice") - 1).alias("slice"), F.lit(True).alias("followed"))
    rows = rows.join(after, PLACE, "left")
    # at the switch to the next slice the maximum becomes A; if that slice stays empty, the place is empty from the one after
    moved = rows.where("at1 IS NOT NULL").select(*place, F.col("at1").alias("at"), F.lit(1).alias("kind"), F.when(slice_of("at1.t", "grp", spec) == F.col("slice") + 1, F.col("top")).alias("value"))
    emptied = rows.where("followed IS NULL AND at2 IS NOT NULL AND at2 > at1").select(*place, F.col("at2").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("value"))
    raised = dated.where("top_before IS NULL OR priority >= top_before").select(*place, F.col("arrival").alias("at"), F.lit(2).alias("kind"), F.col("priority").alias("value"))
    events = moved.unionByName(emptied).unionByName(raised)
    order = Window.partitionBy(*place).orderBy("at", "kind")
    part = F.coalesce(F.expr(f"pow(2D, -{rho_sql('value')})"), F.lit(1.0))
    full = F.col("value").isNotNull().cast("long")
    stated = events.withColumns({"part": part, "full": full})
    return stated.select("seed", "at", "kind", "grp", (F.col("part") - F.coalesce(F.lag("part").over(order), F.lit(1.0))).alias("q"), (F.col("full") - F.coalesce(F.lag("full").over(order), F.lit(0).cast("long"))).alias("occ"))


def pair_probability(edges: DataFrame, lives: DataFrame, spec: SampleSpec) -> DataFrame:
    """(seed, at, kind, t, eid, n, edges, inc, exp): after each arrival's insertion (kind 3) and each expiry of a sampled
    edge (kind 0; t and eid are the edge's), the sample's size, the estimated edges, and the chances of a pair and a triple.
    Stores tables."""
    times = first_of_times(edges)
    dated = stored(dated_records(records_of(assign_slots(edges, spec), []), times, spec, []))
    return chances(edges, life_events(dated, times, lives, spec), spec)


def chances(edges: DataFrame, events: DataFrame, spec: SampleSpec) -> DataFrame:
    """As pair_probability, from the events of the groups' states.

    Rows are dealt to ranges of about equal numbers of rows in their order, summed inside these and then carried over the
    ranges' totals: nothing is ordered over the whole stream, and a burst of edges at one time is many ranges."""
    asked = edges.select("seed", F.struct("t", "eid").alias("at"), F.lit(3).alias("kind"), F.struct(F.lit(-1).cast("long").alias("t"), F.lit(-1).cast("long").alias("eid")).alias("by"))
    log = events.unionByName(asked, allowMissingColumns=True)
    numbers = [(g, c) for g in range(spec.groups) for c in ("valid", "q", "occ")]
    per = {f"{c}_{g}": F.coalesce(F.sum(F.when(F.col("grp") == g, F.col(c))), F.lit(0)) for g, c in numbers}
    # rows of one place in the order change together, so they are added up before the running sums
    order = ["seed", "at", "kind", "by"]
    summed = log.groupBy(*order).agg(*[v.alias(k) for k, v in per.items()])
    ranges = 2 * int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    steps = stored(summed.repartitionByRange(ranges, *order).withColumn("chunk", F.spark_partition_id()))
    inside = Window.partitionBy("seed", "chunk").orderBy("at", "kind", "by").rowsBetween(Window.unboundedPreceding, 0)
    summed = steps.select("seed", "chunk", "at", "kind", "by", *[F.sum(k).over(inside).alias(k) for k in per])
    totals = steps.groupBy("seed", "chunk").agg(*[F.sum(k).alias(k) for k in per])
    earlier = Window.partitionBy("seed").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("seed", "chunk", *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"{k}_before") for k in per])
    rows = summed.where("kind IN (0, 3)").join(carried, ["seed", "chunk"])
    value = lambda c, g: f"({c}_{g} + {c}_{g}_before)"
    n = F.expr(" + ".join(value("valid", g) for g in range(spec.groups)))
    total = reduce(lambda x, y: x + y, [F.expr(group_estimate_sql(value("valid", g), f"({spec.slots} + {value('q', g)})", value("occ", g), spec)) for g in range(spec.groups)])
    sized = rows.select("seed", "at", "kind", F.col("by.t").alias("t"), F.col("by.eid").alias("eid"), n.alias("n"), total.alias("edges"))
    pair = F.when((F.col("n") > 1) & (F.col("edges") > 1), F.col("n") / F.col("edges") * (F.col("n") - 1) / (F.col("edges") - 1))
    return sized.withColumn("inc", pair).withColumn("exp", F.when((F.col("n") > 2) & (F.col("edges") > 2), F.col("inc") * (F.col("n") - 2) / (F.col("edges") - 2)))


def sliced(added: DataFrame, taken: DataFrame | None, graphs: DataFrame, wspec: WindowSpec, length: int, slices: int, types: list[int], before: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(seed, cp, type, estimate) at each of `graphs` (seed, cp, bucket, cp_t, cp_eid): the last slices of `added` (seed, at,
    type, oldest, w) less what `taken` (seed, at, type, w) took in the current one. Rows are summed by slice and step before
    they meet the checkpoints. `before` are the counters so far: (seed, type, slice, w) and (seed, type, now, w)."""
    graphs = graphs.withColumns({"now": now_index("cp_t", length), "point": F.struct(F.col("cp_t").alias("t"), F.col("cp_eid").alias("eid"))})
    points = graphs.select("bucket", "point").distinct()

    def visible(rows: DataFrame) -> DataFrame:
        own = rows.withColumn("bucket", F.expr(f"at.t div {wspec.step}")).join(points, "bucket", "left")
        return own.withColumn("visible", F.when(F.col("at") <= F.col("point"), F.col("bucket")).otherwise(F.col("bucket") + 1))

    kept = visible(added).withColumn("slice", slice_index("oldest", length)).groupBy("seed", "type", "slice", "visible").agg(F.sum("w").alias("w"))
    earlier = lambda k: before[k].withColumn("visible", F.lit(-1).cast("long"))
    kept = kept if before is None else kept.unionByName(earlier(0))
    at = graphs.select("seed", "cp", F.col("bucket").alias("cp_bucket"), "now")
    in_slices = at.withColumn("slice", F.explode(F.sequence(F.col("now") - slices, F.col("now"))))
    gained = in_slices.join(kept, ["seed", "slice"]).where("visible <= cp_bucket").groupBy("seed", "cp", "type").agg(F.sum("w").alias("gained"))
    every = at.select("seed", "cp", F.explode(F.array(*[F.lit(k) for k in types])).alias("type"))
    out = every.join(gained, ["seed", "cp", "type"], "left")
    value = F.coalesce("gained", F.lit(0.0))
    if taken is not None:
        lost = visible(taken).withColumn("now", now_index("at.t", length)).groupBy("seed", "type", "now", "visible").agg(F.sum("w").alias("w"))
        lost = lost if before is None else lost.unionByName(earlier(1))
        lost = at.join(lost, ["seed", "now"]).where("visible <= cp_bucket").groupBy("seed", "cp", "type").agg(F.sum("w").alias("lost"))
        out = out.join(lost, ["seed", "cp", "type"], "left")
        value = value - F.coalesce("lost", F.lit(0.0))
    return out.select("seed", "cp", "type", value.alias("estimate"))


def weighed_arrivals(edges: DataFrame, lives: DataFrame, sized: DataFrame, window: int, directed: bool, types: list[int]) -> DataFrame:
    """(seed, at, type, oldest, w): triangles by the arrival that closes them and their oldest time, 1 / inc each."""
    come = arrival_triangles(edges, lives, window, directed).where(F.col("type").isin(types)).groupBy("seed", "at", "type", "oldest").agg(F.count(F.lit(1)).alias("k"))
    return come.join(sized.where("kind = 3").select("seed", "at", "inc"), ["seed", "at"]).select("seed", "at", "type", "oldest", F.coalesce(F.col("k") / F.col("inc"), F.lit(0.0)).alias("w"))


def weighed_expiries(lives: DataFrame, sized: DataFrame, window: int, length: int, directed: bool, types: list[int], since: str = "true") -> DataFrame:
    """(seed, at, type, w): triangles of expiring edges that the last slices still hold, 1 / exp each; of the expiries
    `at` which the SQL condition `since` holds."""
    boundary = now_index("at.t", length) * length
    gone = expired_triangles(lives, window, directed, since).where(F.col("type").isin(types)).where(F.col("t") > boundary - window).groupBy("seed", "at", "t", "eid", "type").agg(F.count(F.lit(1)).alias("k"))
    return gone.join(sized.where("kind = 0").select("seed", "at", "t", "eid", "exp"), ["seed", "at", "t", "eid"]).select("seed", "at", "type", F.coalesce(F.col("k") / F.col("exp"), F.lit(0.0)).alias("w"))


def cbs_directed_estimate(edges: DataFrame, wspec: WindowSpec, spec: SampleSpec, slices: int = 10, correct: bool = True, directed: bool = True, types: list[int] | None = None) -> DataFrame:
    """(seed, cp, type, estimate): triangles counted as they arrive, 1 / inc each, in the slice of their oldest edge; less
    1 / exp for triangles of the current slice's expiries, unless `correct` is off. Stores tables."""
    types = types or (list(CLOSINGS) if directed else [-1])
    length, keep = wspec.window // slices, ["s", "d", *["bi"] * directed]
    edges = stored(edges)
    times = first_of_times(edges)
    dated = stored(dated_records(records_of(assign_slots(edges, spec), keep), times, spec, keep))
    lives = stored(lives_of(dated, spec, keep))
    sized = stored(chances(edges, life_events(dated, times, lives, spec), spec))
    added = stored(weighed_arrivals(edges, lives, sized, wspec.window, directed, types))
    taken = stored(weighed_expiries(lives, sized, wspec.window, length, directed, types)) if correct else None
    return sliced(added, taken, _graphs(edges, checkpoints(edges, wspec.step)), wspec, length, slices, types)


def cbs_estimate(edges: DataFrame, wspec: WindowSpec, spec: SampleSpec, slices: int = 10, correct: bool = True) -> DataFrame:
    """(seed, cp, estimate) of undirected graphs."""
    return cbs_directed_estimate(edges, wspec, spec, slices, correct, directed=False).drop("type")


def fixed_p_sliced_estimate(edges: DataFrame, wspec: WindowSpec, p: float, slices: int = 10) -> DataFrame:
    """(seed, cp, estimate): as above with a sample of fixed probability: arrivals add 1 / p^2, before they are sampled
    themselves, to the slice of the older of the two sampled edges; every expiry takes 1 / p^3; never below 0."""
    length = wspec.window // slices
    kept = bernoulli_edges(edges, p)
    times = first_of_times(edges)
    asked = kept.select((F.col("t") + wspec.window + 1).alias("x"))
    ends = first_arrivals(times, asked, chunk_length(wspec.window))
    lives = kept.withColumn("x", F.col("t") + wspec.window + 1).join(ends, "x").withColumns({"start": F.struct("t", "eid"), "end": F.col("at"), "expired": F.col("at").isNotNull()}).drop("x", "at")
    points = _points(edges.withColumn("at", F.struct("t", "eid")), False)
    come = _closed(points, lives, wspec.window, False, "{f}_start < at AND ({f}_end IS NULL OR {f}_end > at)")
    added = come.select("seed", "at", "type", F.least("f_life_t", "g_life_t").alias("oldest"), F.lit(1 / p**2).alias("w"))
    taken = expired_triangles(lives, wspec.window).select("seed", "at", "type", F.lit(1 / p**3).alias("w"))
    out = sliced(added, taken, _graphs(edges, checkpoints(edges, wspec.step)), wspec, length, slices, [-1])
    return out.select("seed", "cp", F.greatest("estimate", F.lit(0.0)).alias("estimate"))
