"""Exact counts of the sliding window by what changes between its checkpoints.

No edge is copied to the checkpoints that see it. A pair's number of instances is constant over
spans of checkpoints; three pairs' spans that overlap make a triangle over the overlap, found
once; and a count is a running sum of what comes and goes. A span is no longer than an edge's
life, so the join looks inside chunks of that many checkpoints, each span being in two at most.
Inside a chunk pairs are turned towards the hubs, so that these make few paths.

Spans and the table of steps are stored while a plan is made: calling a function of this module runs jobs. Inside
materialize.temporary_tables() they go at its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trellisway.functions.materialize import stored
from trellisway.operators import directed as dg
from trellisway.operators.prepare import WindowSpec, checkpoints
from trellisway.operators.triangles import meeting_nodes, neighbours_of_both
from trellisway.operators.window import seen_from

_SPAN = ["cp_from", "cp_to"]

#: A node with more new spans in a chunk counts as a hub there; pairs are turned towards hubs.
HUB = 512


def _plain() -> dict[str, Column]:
    return {"f": F.lit(1)}


def _relations() -> dict[str, Column]:
    """One-way edges from the larger id to the smaller, back, and two-way ones."""
    one = lambda keep: F.when(keep, 1).otherwise(0)
    return {"down": one(~F.col("bi") & (F.col("s") > F.col("d"))), "up": one(~F.col("bi") & (F.col("s") < F.col("d"))), "two": one(F.col("bi"))}


def _both_ends(value: Column, *more: Column) -> Column:
    """What comes at the first checkpoint of a span and goes after its last."""
    at = lambda cp, v: F.struct(cp.alias("cp"), v.alias("by"), *more)
    return F.array(at(F.col("cp_from"), value), at(F.col("cp_to") + 1, -value))


def pair_spans(edges: DataFrame, points: DataFrame, spec: WindowSpec, by: list[str] | None = None, directed: bool = False, times: DataFrame | None = None, numbers: dict[str, Column] | None = None) -> DataFrame:
    """(by..., s, d, f, cp_from, cp_to) with s > d, or with down, up and two or the sums of `numbers` for f: spans of checkpoints
    in which the window holds a pair, each with constant numbers. `times` are the arrivals that steps are taken from, if not
    `edges` alone."""
    by = by or []
    numbers = numbers or (_relations() if directed else _plain())
    rows = edges.select(*by, F.greatest("s", "d").alias("s"), F.least("s", "d").alias("d"), *[v.alias(k) for k, v in numbers.items()], F.struct("t", "eid").alias("arrival"))
    # a join for each corner and side follows, so the spans are made once
    return stored(spans_of(seen_from(rows, edges if times is None else times, points, spec, "arrival", "arrival.t"), by, list(numbers)))


def spans_of(alive: DataFrame, by: list[str], numbers: list[str]) -> DataFrame:
    """(by..., s, d, numbers..., cp_from, cp_to): spans in which the sums of the numbers of a pair's rows are constant and not all 0."""
    sign = F.explode(_both_ends(F.lit(1))).alias("x")
    # rows go to their pair once, each before it is two; both sums follow there
    summed = alive.select(*by, "s", "d", *numbers, *_SPAN).repartition(*by, "s", "d").select(*by, "s", "d", *numbers, sign).groupBy(*by, "s", "d", F.col("x.cp").alias("cp")).agg(*[F.sum(F.col(k) * F.col("x.by")).alias(k) for k in numbers])
    changed = summed.where(" OR ".join(f"{k} <> 0" for k in numbers))
    order = Window.partitionBy(*by, "s", "d").orderBy("cp")
    spans = changed.select(*by, "s", "d", F.col("cp").alias("cp_from"), (F.lead("cp").over(order) - 1).alias("cp_to"), *[F.sum(k).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(k) for k in numbers])
    return spans.where(" + ".join(numbers) + " > 0")


def edge_frequencies(edges: DataFrame, spec: WindowSpec, directed: bool = False) -> DataFrame:
    """(cp, s, d, f), or (cp, s, d, bi, f): how often each edge is in the window of each checkpoint."""
    spans = pair_spans(edges, checkpoints(edges, spec.step), spec, directed=directed)
    at = F.explode(F.sequence("cp_from", "cp_to")).alias("cp")
    if not directed:
        return spans.select(at, "s", "d", "f")
    one = lambda s, d, bi, f: F.struct(F.col(s).alias("s"), F.col(d).alias("d"), F.lit(bi).alias("bi"), F.col(f).alias("f"))
    rows = spans.select(*_SPAN, F.explode(F.array(one("s", "d", False, "down"), one("d", "s", False, "up"), one("s", "d", True, "two"))).alias("e")).where("e.f > 0")
    return rows.select(at, "e.*")


def window_sizes(edges: DataFrame, spec: WindowSpec, directed: bool = False) -> DataFrame:
    """(cp, distinct_edges, instances, nodes) of the window at every checkpoint."""
    points = checkpoints(edges, spec.step)
    spans = pair_spans(edges, points, spec, directed=directed)
    kinds = [F.col(k) for k in (_relations() if directed else _plain())]
    distinct, instances = sum(((k > 0).cast("long") for k in kinds), F.lit(0)), sum(kinds, F.lit(0))
    order = Window.partitionBy("node").orderBy("cp")
    upto = F.sum("there").over(order.rowsBetween(Window.unboundedPreceding, 0))
    held = _node_changes(spans).withColumn("now", (upto > 0).cast("long")).withColumn("nodes", F.col("now") - F.coalesce(F.lag("now").over(order), F.lit(0)))
    zero = F.lit(0).cast("long")
    sizes = spans.select(F.explode(F.array(F.struct(F.col("cp_from").alias("cp"), distinct.alias("distinct_edges"), instances.alias("instances")), F.struct((F.col("cp_to") + 1).alias("cp"), (-distinct).alias("distinct_edges"), (-instances).alias("instances")))).alias("x")).select("x.*", zero.alias("nodes"))
    both = sizes.unionByName(held.select("cp", zero.alias("distinct_edges"), zero.alias("instances"), "nodes"))
    values = ["distinct_edges", "instances", "nodes"]
    return _at_points(both.groupBy("cp").agg(*[F.sum(v).alias(v) for v in values]), points.select("cp"), [], values)


def _node_changes(spans: DataFrame) -> DataFrame:
    """(node, cp, there): by how much the number of a node's pairs changes."""
    nodes = spans.select(F.explode(F.array("s", "d")).alias("node"), *_SPAN)
    return nodes.select("node", F.explode(_both_ends(F.lit(1).cast("long"))).alias("x")).groupBy("node", F.col("x.cp").alias("cp")).agg(F.sum("x.by").alias("there")).where("there <> 0")


def wedge_count(edges: DataFrame, spec: WindowSpec) -> DataFrame:
    """(cp, wedges): paths of length two over distinct neighbours, by what each change of a node's degree adds."""
    points = checkpoints(edges, spec.step)
    order = Window.partitionBy("node").orderBy("cp")
    degree = F.sum("there").over(order.rowsBetween(Window.unboundedPreceding, 0))
    now = _node_changes(pair_spans(edges, points, spec)).withColumn("degree", degree).withColumn("now", F.expr("degree * (degree - 1) div 2"))
    changes = now.withColumn("by", F.col("now") - F.coalesce(F.lag("now").over(order), F.lit(0).cast("long"))).groupBy("cp").agg(F.sum("by").alias("wedges"))
    return _at_points(changes, points.select("cp"), [], ["wedges"])


def common_neighbors(edges: DataFrame, spec: WindowSpec, pairs: DataFrame | None = None) -> DataFrame:
    """(cp, x, y, common, weighted, nodes) of the asked pairs (x, y, cp_from, cp_to) at each of their checkpoints, by default
    of every pair of the window: neighbours of both, the sum of products of frequencies, and the sorted list.

    Pairs of the window have what lies opposite to them in their triangles; of asked pairs, neighbours meet over spans, from
    the end with fewer of them. What is found goes to its pair as spans, and only there is it copied to the checkpoints."""
    spans = pair_spans(edges, checkpoints(edges, spec.step), spec)
    asked, found = _opposite_nodes(spans, spec) if pairs is None else _met_neighbours(spans, _apart(pairs), spec)
    key = ["x", "y", "start"]
    # plain rows are shuffled, lists are made where they have come to
    both = asked.select(*key, F.col("cp_to").alias("until")).unionByName(found.select(*key, "z", "w", *_SPAN), allowMissingColumns=True).repartition(*key)
    near = F.when(F.col("z").isNotNull(), F.struct("z", "w", *_SPAN))
    lists = both.groupBy(*key).agg(F.max("until").alias("until"), F.sort_array(F.collect_list(near)).alias("near"))
    at = F.explode(F.sequence("start", "until")).alias("cp")
    # sorted by node, and a node is there once at a checkpoint
    seen = lists.select(at, "x", "y", "near").select("cp", "x", "y", F.filter("near", lambda n: (n["cp_from"] <= F.col("cp")) & (n["cp_to"] >= F.col("cp"))).alias("near"))
    total = F.aggregate("near", F.lit(0).cast("long"), lambda sum_, n: sum_ + n["w"])
    return seen.select("cp", "x", "y", F.size("near").cast("long").alias("common"), total.alias("weighted"), F.col("near")["z"].alias("nodes"))


def _opposite_nodes(spans: DataFrame, spec: WindowSpec) -> tuple[DataFrame, DataFrame]:
    """(x, y, start, cp_to), the spans of all pairs, and (x, y, start, z, w, cp_from, cp_to), the nodes that lie opposite to
    them in triangles. A triangle over constant numbers lies in one span of each of its pairs."""
    asked = spans.select(F.col("s").alias("x"), F.col("d").alias("y"), F.col("cp_from").alias("start"), "cp_to")
    opposite = lambda pair, z, one, two: F.struct(F.col(pair)["s"].alias("x"), F.col(pair)["d"].alias("y"), F.col(pair)["cp_from"].alias("start"), F.col(z).alias("z"), (F.col(one)["f"] * F.col(two)["f"]).alias("w"))
    sides = F.array(opposite("ab", "c", "ac", "bc"), opposite("ac", "b", "ab", "bc"), opposite("bc", "a", "ab", "ac"))
    return asked, triangle_spans(spans, spec, [], ["f", "cp_from"]).select(F.explode(sides).alias("e"), *_SPAN).select("e.*", *_SPAN)


def _apart(pairs: DataFrame) -> DataFrame:
    """The asked pairs (x, y, cp_from, cp_to) without what is asked more than once."""
    order = Window.partitionBy("x", "y").orderBy("cp_from", "cp_to").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("cp_from", F.max("cp_to").over(order) + 1)
    return pairs.select("x", "y", *_SPAN).withColumn("cp_from", begin).where("cp_from <= cp_to")


def _met_neighbours(spans: DataFrame, pairs: DataFrame, spec: WindowSpec) -> tuple[DataFrame, DataFrame]:
    """As _opposite_nodes, of any pairs (x, y, cp_from, cp_to), which are cut at the ends of chunks."""
    length = spec.window // spec.step + 2
    chunk = F.explode(F.sequence(F.expr(f"cp_from div {length}"), F.expr(f"cp_to div {length}"))).alias("chunk")
    asked = pairs.select(chunk, "x", "y", *_SPAN).select("chunk", "x", "y", F.greatest("cp_from", F.col("chunk") * length).alias("start"), F.least("cp_to", F.col("chunk") * length + length - 1).alias("cp_to"))
    met = neighbours_of_both(spans.select(chunk, "s", "d", "f", F.struct(*_SPAN).alias("span")), asked, ["chunk"], ["span"])
    begin, end = (pick(c, f"x_span.cp_{k}", f"y_span.cp_{k}") for pick, c, k in ((F.greatest, "start", "from"), (F.least, "cp_to", "to")))
    found = met.withColumns({"cp_from": begin, "cp_to": end}).where("cp_from <= cp_to")
    return asked.drop("chunk"), found.select("x", "y", "start", "z", (F.col("f_x") * F.col("f_y")).alias("w"), *_SPAN)


def triangle_spans(spans: DataFrame, spec: WindowSpec, by: list[str], keep: list[str]) -> DataFrame:
    """(by..., a, b, c, ab, ac, bc, cp_from, cp_to): each triangle of pairs over each span of constant numbers, once; of a
    pair s, d and what is asked for in `keep`.

    Nodes of triangles are found first, by ids alone, and stored; only these meet the spans of their pairs."""
    length = spec.window // spec.step + 2
    first, last = F.expr(f"cp_from div {length}"), F.expr(f"cp_to div {length}")
    key = [*by, "chunk"]
    begun = spans.select(*by, F.explode(F.array("s", "d")).alias("node"), first.alias("chunk")).groupBy(*key, "node").agg(F.count(F.lit(1)).alias("n"))
    # a span is in the chunk in which it begins and at most the next one
    hubs = begun.where(f"n > {HUB}").select(*by, "node", "n", F.explode(F.expr("array(chunk, chunk + 1)")).alias("chunk")).groupBy(*key, "node").agg(F.sum("n").alias("n"))
    found = stored(meeting_nodes(spans.select(*by, F.explode(F.sequence(first, last)).alias("chunk"), "s", "d"), key, stored(hubs)))
    # all three sides ask for the same rows, so spans are shuffled once
    whole = spans.where("cp_from <= cp_to")
    for pair in ("ab", "ac", "bc"):
        span = {c: f"_{pair}_{c}" for c in ("s", "d", *keep, *_SPAN)}
        ends = found.withColumns({span["s"]: F.greatest(*pair), span["d"]: F.least(*pair)})
        met = ends.join(whole.select(*by, *[F.col(c).alias(k) for c, k in span.items()]), [*by, span["s"], span["d"]])
        # of a pair only what its nodes don't tell goes on
        here = met.withColumn(pair, F.struct(*[F.col(span[c]).alias(c) for c in keep])) if keep else met
        begin, end = (pick(span[c], f"_met.{c}") if "_met" in found.columns else F.col(span[c]) for pick, c in ((F.greatest, "cp_from"), (F.least, "cp_to")))
        found = here.withColumn("_met", F.struct(begin.alias("cp_from"), end.alias("cp_to"))).drop(*span.values()).where(f"_met.cp_from <= _met.cp_to AND _met.cp_from div {length} <= chunk AND _met.cp_to div {length} >= chunk")
    # a triangle of two chunks belongs to the one in which it begins
    sides = [F.struct(F.greatest(*pair).alias("s"), F.least(*pair).alias("d"), *[F.col(pair)[c].alias(c) for c in keep]).alias(pair) for pair in ("ab", "ac", "bc")]
    return found.where(f"chunk = _met.cp_from div {length}").select(*by, "a", "b", "c", *sides, "_met.*")


def _weight(weighted: bool) -> Column:
    return F.col("ab.f") * F.col("ac.f") * F.col("bc.f") if weighted else F.lit(1).cast("long")


def _at_points(changes: DataFrame, every: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Running sums of changes (keys..., cp, values...) at every (keys..., cp)."""
    order = Window.partitionBy(*keys).orderBy("cp").rowsBetween(Window.unboundedPreceding, 0)
    return every.join(changes, [*keys, "cp"], "left").select("cp", *keys, *[F.sum(F.coalesce(v, F.lit(0).cast("long"))).over(order).alias(v) for v in values])


def triangle_count(edges: DataFrame, spec: WindowSpec, weighted: bool = False, by: list[str] | None = None, times: DataFrame | None = None) -> DataFrame:
    """(by..., cp, triangles) at every checkpoint of `times`: distinct pairs, or with `weighted` every choice of instances."""
    by = by or []
    points = checkpoints(edges if times is None else times, spec.step)
    found = triangle_spans(pair_spans(edges, points, spec, by, times=times), spec, by, ["f"])
    changes = found.select(*by, F.explode(_both_ends(_weight(weighted))).alias("x")).groupBy(*by, "x.cp").agg(F.sum("x.by").alias("triangles"))
    every = points.select("cp")
    if by:
        every = every.crossJoin(edges.select(*by).distinct())
    return _at_points(changes, every, by, ["triangles"])


def counts_of_parts(edges: DataFrame, spec: WindowSpec, parts: dict[str, Column]) -> DataFrame:
    """(cp, triangles, parts...): the weighted count of all edges, and of those alone for which a part's column is 1 and not 0.

    Triangles of a part lie on triangles of all edges, so these are found once for all of them."""
    points = checkpoints(edges, spec.step)
    numbers = {"triangles": F.lit(1), **parts}
    found = triangle_spans(pair_spans(edges, points, spec, numbers=numbers), spec, [], list(numbers))
    weights = [(F.col("ab")[k] * F.col("ac")[k] * F.col("bc")[k]).alias(k) for k in numbers]
    both = found.select(F.struct(*weights).alias("w"), F.explode(_both_ends(F.lit(1))).alias("x"))
    changes = both.groupBy("x.cp").agg(*[F.sum(F.col("w")[k] * F.col("x.by")).alias(k) for k in numbers])
    return _at_points(changes, points.select("cp"), [], list(numbers))


def window_deltas(edges: DataFrame, spec: WindowSpec) -> DataFrame:
    """(cp, triangles): the weighted count, with what came and went since the checkpoint before as `change`."""
    counts = triangle_count(edges, spec, weighted=True)
    before = F.lag("triangles", 1, 0).over(Window.orderBy("cp"))
    return counts.select("cp", "triangles", (F.col("triangles") - before).alias("change"))


def _present(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(cp, keys..., triangles) at each checkpoint at which `there` adds up to more than 0; sums: (keys..., cp, w, there) of changes."""
    order = Window.partitionBy(*keys).orderBy("cp")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    spans = sums.select(*keys, F.col("cp").alias("cp_from"), (F.lead("cp").over(order) - 1).alias("cp_to"), F.sum("w").over(upto).alias("triangles"), F.sum("there").over(upto).alias("there"))
    return spans.where("there > 0").select(F.explode(F.sequence("cp_from", "cp_to")).alias("cp"), *keys, "triangles")


def _with_presence(found: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    zero = F.lit(0).cast("long")
    both = found.select(*keys, F.explode(_both_ends(F.col("w"))).alias("x")).select(*keys, "x.cp", F.col("x.by").alias("w"), zero.alias("there"))
    there = present.select(*keys, F.explode(_both_ends(F.lit(1).cast("long"))).alias("x")).select(*keys, "x.cp", zero.alias("w"), F.col("x.by").alias("there"))
    sums = both.unionByName(there).groupBy(*keys, "cp").agg(F.sum("w").alias("w"), F.sum("there").alias("there"))
    return _present(sums.where("w <> 0 OR there <> 0"), keys)


def local_triangle_count(edges: DataFrame, spec: WindowSpec, weighted: bool = False) -> DataFrame:
    """(cp, node, triangles) for every node of the window."""
    spans = pair_spans(edges, checkpoints(edges, spec.step), spec)
    found = triangle_spans(spans, spec, [], ["f"]).select(F.explode(F.array("a", "b", "c")).alias("node"), _weight(weighted).alias("w"), *_SPAN)
    return _with_presence(found, spans.select(F.explode(F.array("s", "d")).alias("node"), *_SPAN), ["node"])


def edge_triangle_count(edges: DataFrame, spec: WindowSpec) -> DataFrame:
    """(cp, s, d, triangles) for every pair of the window: in how many triangles of distinct pairs it is.

    A triangle goes to the one span of each of its pairs that it lies in, so spans and triangles are shuffled once."""
    spans = pair_spans(edges, checkpoints(edges, spec.step), spec)
    key, zero = ["s", "d", "start"], F.lit(0).cast("long")
    side = lambda p: F.struct(F.col(p)["s"].alias("s"), F.col(p)["d"].alias("d"), F.col(p)["cp_from"].alias("start"))
    found = triangle_spans(spans, spec, [], ["cp_from"]).select(F.explode(F.array(side("ab"), side("ac"), side("bc"))).alias("e"), *_SPAN).select("e.*", *_SPAN)
    both = spans.select("s", "d", F.col("cp_from").alias("start"), F.col("cp_to").alias("until")).unionByName(found, allowMissingColumns=True).repartition(*key)
    begun = F.array(F.struct(F.col("start").alias("cp"), zero.alias("by")))
    changes = both.select(*key, "until", F.explode(F.when(F.col("until").isNull(), _both_ends(F.lit(1).cast("long"))).otherwise(begun)).alias("x"))
    sums = changes.groupBy(*key, F.col("x.cp").alias("cp")).agg(F.max("until").alias("until"), F.sum("x.by").alias("by"))
    order = Window.partitionBy(*key).orderBy("cp")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    # what begins after a span's end is not there
    constant = sums.select("s", "d", F.col("cp").alias("cp_from"), F.coalesce(F.lead("cp").over(order) - 1, F.max("until").over(upto)).alias("cp_to"), F.sum("by").over(upto).alias("triangles")).where("cp_from <= cp_to")
    return constant.select(F.explode(F.sequence("cp_from", "cp_to")).alias("cp"), "s", "d", "triangles")


def triangle_census(edges: DataFrame, spec: WindowSpec, types: list[int] | None = None) -> DataFrame:
    """(cp, type, triangles, weighted): both counts of the asked directed types, all seven by default, in one pass."""
    types = list(dg.TYPES) if types is None else types
    points = checkpoints(edges, spec.step)
    found = triangle_spans(pair_spans(edges, points, spec, directed=True), spec, [], ["down", "up", "two"])
    counted = dg.typed(found, types, _SPAN)
    signed = counted.select("type", "n", "weighted", F.explode(_both_ends(F.lit(1))).alias("x"))
    changes = signed.groupBy("type", "x.cp").agg(*[F.sum(F.col(v) * F.col("x.by")).alias(name) for v, name in (("n", "triangles"), ("weighted", "weighted"))])
    every = points.select("cp", F.explode(F.array(*[F.lit(k) for k in types])).alias("type"))
    return _at_points(changes, every, ["type"], ["triangles", "weighted"])


def directed_triangle_count(edges: DataFrame, spec: WindowSpec, weighted: bool = False, types: list[int] | None = None) -> DataFrame:
    """(cp, type, triangles)."""
    return triangle_census(edges, spec, types).select("cp", "type", F.col("weighted" if weighted else "triangles").alias("triangles"))


def directed_local_count(edges: DataFrame, spec: WindowSpec, weighted: bool = False, types: list[int] | None = None) -> DataFrame:
    """(cp, type, node, triangles) for every node of the window and asked type."""
    types = list(dg.TYPES) if types is None else types
    spans = pair_spans(edges, checkpoints(edges, spec.step), spec, directed=True)
    found = dg.typed(triangle_spans(spans, spec, [], ["down", "up", "two"]), types, [*_SPAN])
    each = found.select("type", F.explode("nodes").alias("node"), F.col("weighted" if weighted else "n").alias("w"), *_SPAN)
    nodes = spans.select(F.explode(F.array("s", "d")).alias("node"), *_SPAN)
    return _with_presence(each, nodes.withColumn("type", F.explode(F.array(*[F.lit(k) for k in types]))), ["type", "node"])


def local_count_a(edges: DataFrame, spec: WindowSpec, weighted: bool = False) -> DataFrame:
    """directed_local_count of type A."""
    return directed_local_count(edges, spec, weighted, [0])


def local_count_b(edges: DataFrame, spec: WindowSpec, weighted: bool = False) -> DataFrame:
    """directed_local_count of type B."""
    return directed_local_count(edges, spec, weighted, [1])
