"""Exact triangles of undirected graphs; one graph for each value of the `by` columns.

Pairs come as rows (by..., s, d, f) with s > d and their number f. Each pair is turned from
its end with fewer neighbours to the other (ties by id), so no node has more than about
sqrt(2 E) pairs going out and hubs make few paths; a triangle is found once, at the node
that both its other nodes are reached from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., node, degree): distinct neighbours."""
    return pairs.select(*by, F.explode(F.array("s", "d")).alias("node")).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))


def meeting_nodes(pairs: DataFrame, by: list[str], hubs: DataFrame) -> DataFrame:
    """(by..., a, b, c): the nodes of each triangle of pairs (by..., s, d) once, whatever the number of rows of a pair. Among
    them are few without a pair of a and c, which have to be looked up: far ends are held against others by 16 bits.

    Pairs are turned to the end that is a hub (by..., node, n), of two hubs to the greater one, else to the greater id. A
    node's far ends are a list; from each of them the list goes on to the next ends, and what is in both lists is found:
    a path takes 2 bytes of an array, 8 on the way to a hub, and no row. If each node of more than k pairs is a hub, and n at
    least its number, no list has more than k or, for a hub, the number of hubs that are as great."""
    of = lambda c: hubs.select(*by, F.col("node").alias(c), F.col("n").alias(f"n_{c}"))
    ranked = pairs.join(of("s"), [*by, "s"], "left").join(of("d"), [*by, "d"], "left")
    one, two = (F.struct(F.coalesce(f"n_{c}", F.lit(0).cast("long")).alias("n"), F.col(c).alias("node")) for c in "sd")
    # both joined sides ask for the same rows, so the lists are shuffled once
    turned = ranked.select(*by, F.least(one, two)["node"].alias("a"), F.greatest(one, two).alias("far")).where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, "a"]))
    lists = turned.groupBy(*by, "a").agg(F.sort_array(F.collect_set("far")).alias("far"))
    bits = lambda ids: F.transform(ids, lambda x: F.shiftright(F.xxhash64(x), 48).cast("short"))
    each = lists.where("size(far) > 1").select(*by, "a", "far", bits(F.col("far")["node"]).alias("bits")).select(*by, "a", F.posexplode("far").alias("at", "b"), "far", "bits").where("at < size(far) - 1")
    # few enough ids lie beyond a node that is no hub to tell them apart by less than an id
    paths = each.select(*by, "a", F.col("b.node").alias("b"), F.expr("CASE WHEN b.n > 0 THEN slice(far.node, at + 2, size(far)) END AS ends"), F.expr("CASE WHEN b.n = 0 THEN slice(bits, at + 2, size(far)) END AS bits"))
    met = paths.join(lists.select(*by, F.col("a").alias("b"), F.col("far")["node"].alias("next"), bits(F.col("far")["node"]).alias("next_bits")), [*by, "b"])
    held = met.withColumn("both", F.array_intersect("bits", "next_bits")).where("ends IS NOT NULL OR size(both) > 0")
    like = F.filter("next", lambda x, i: F.array_contains("both", F.element_at("next_bits", i + 1)))
    return held.select(*by, "a", "b", F.explode(F.when(F.col("ends").isNotNull(), F.array_intersect("ends", "next")).otherwise(like)).alias("c"))


def triangles(pairs: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """(by..., a, b, c, ab, ac, bc): each triangle once, and of each pair a struct of s, d and the `keep` columns."""
    degree = degrees(pairs, by)
    end = lambda c: degree.select(*by, F.col("node").alias(c), F.col("degree").alias(f"degree_{c}"))
    ranked = pairs.join(end("s"), [*by, "s"]).join(end("d"), [*by, "d"])
    s_first = F.struct("degree_s", "s") < F.struct("degree_d", "d")
    turned = ranked.select(*by, F.when(s_first, F.col("s")).otherwise(F.col("d")).alias("a"), F.when(s_first, F.col("d")).otherwise(F.col("s")).alias("b"), F.struct("s", "d", *keep).alias("ab"))
    other = turned.select(*by, "a", F.col("b").alias("c"), F.col("ab").alias("ac"))
    wedges = turned.join(other, [*by, "a"]).where("b > c")
    closing = pairs.select(*by, F.col("s").alias("b"), F.col("d").alias("c"), F.struct("s", "d", *keep).alias("bc"))
    return wedges.join(closing, [*by, "b", "c"])


def _weight(weighted: bool):
    return F.col("ab.f") * F.col("ac.f") * F.col("bc.f") if weighted else F.lit(1).cast("long")


def triangle_count(frequencies: DataFrame, by: list[str], weighted: bool = False, every: DataFrame | None = None) -> DataFrame:
    """(by..., triangles): distinct pairs, or with `weighted` every choice of instances. `every` lists graphs that have a row in any case."""
    out = triangles(frequencies, by, ["f"]).groupBy(*by).agg(F.sum(_weight(weighted)).alias("triangles"))
    return out if every is None else every.select(*by).join(out, by, "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))


def local_triangle_count(frequencies: DataFrame, by: list[str], weighted: bool = False) -> DataFrame:
    """(by..., node, triangles) for every node."""
    found = triangles(frequencies, by, ["f"]).select(*by, _weight(weighted).alias("w"), F.explode(F.array("a", "b", "c")).alias("node"))
    nodes = frequencies.select(*by, F.lit(0).cast("long").alias("w"), F.explode(F.array("s", "d")).alias("node"))
    return found.unionByName(nodes).groupBy(*by, "node").agg(F.sum("w").alias("triangles"))


def edge_triangle_count(frequencies: DataFrame, by: list[str]) -> DataFrame:
    """(by..., s, d, triangles) for every pair: in how many triangles of distinct pairs it is."""
    found = triangles(frequencies, by, ["f"]).select(*by, F.explode(F.array("ab", "ac", "bc")).alias("p")).select(*by, "p.s", "p.d", F.lit(1).cast("long").alias("w"))
    return found.unionByName(frequencies.select(*by, "s", "d", F.lit(0).cast("long").alias("w"))).groupBy(*by, "s", "d").agg(F.sum("w").alias("triangles"))


def wedge_count(frequencies: DataFrame, by: list[str]) -> DataFrame:
    """(by..., wedges): paths of length two over distinct neighbours."""
    return degrees(frequencies, by).groupBy(*by).agg(F.sum(F.expr("degree * (degree - 1) div 2")).alias("wedges"))


def neighbours_of_both(pairs: DataFrame, asked: DataFrame, by: list[str], keep: list[str]) -> DataFrame:
    """The rows of `asked` (by..., x, y, ...) with each neighbour z that both have, its frequencies f_x and f_y, and the kept
    columns of both pairs as x_* and y_*. The end with fewer neighbours is gone through, the other looked up by z."""
    values = ["f", *keep]
    either = pairs.select(*by, F.col("s").alias("node"), F.col("d").alias("z"), *values).unionByName(pairs.select(*by, F.col("d").alias("node"), F.col("s").alias("z"), *values))
    degree = either.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: degree.select(*by, F.col("node").alias(c), F.col("n").alias(f"_n_{c}"))
    turned = F.col("_n_y") < F.col("_n_x")
    sized = asked.join(of("x"), [*by, "x"]).join(of("y"), [*by, "y"]).withColumns({"_turned": turned, "_near": F.when(turned, F.col("y")).otherwise(F.col("x")), "_far": F.when(turned, F.col("x")).otherwise(F.col("y"))})
    side = lambda p, c: either.select(*by, F.col("node").alias(c), "z", *[F.col(v).alias(f"_{p}_{v}") for v in values])
    met = sized.join(side("p", "_near"), [*by, "_near"]).join(side("q", "_far"), [*by, "_far", "z"])
    pick = lambda v, x, y: F.when(F.col("_turned"), F.col(f"_{x}_{v}")).otherwise(F.col(f"_{y}_{v}"))
    out = {f"{'f_' if v == 'f' else ''}{c}{'' if v == 'f' else '_' + v}": pick(v, *("qp" if c == "x" else "pq")) for v in values for c in "xy"}
    return met.select(*asked.columns, "z", *[v.alias(k) for k, v in out.items()])


def common_neighbors(frequencies: DataFrame, pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., x, y, common, weighted, nodes) of the asked pairs (by..., x, y): neighbours of both, how many, the sum of
    products of frequencies, and the sorted list. Pairs without any have zeros and an empty list."""
    asked = pairs.select(*by, "x", "y").distinct()
    zero = F.lit(0).cast("long")
    met = neighbours_of_both(frequencies, asked, by, []).select(*by, "x", "y", "z", "f_x", "f_y")
    none = asked.select(*by, "x", "y", F.lit(None).cast("long").alias("z"), zero.alias("f_x"), zero.alias("f_y"))
    return met.unionByName(none).groupBy(*by, "x", "y").agg(F.count("z").alias("common"), F.sum(F.col("f_x") * F.col("f_y")).alias("weighted"), F.sort_array(F.collect_list("z")).alias("nodes"))
