"""Directed triangles of seven types.

One-way and two-way edges are separate relations: s->d and d->s don't make a two-way edge,
so one triple of nodes can hold several types. Candidates are the triangles of the
undirected pairs, turned by degree so that hubs make few paths; each candidate carries the
numbers of all relations on its three pairs, and all types are counted on it at once."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trellisway.operators.triangles import triangles

#: The types as edges between roles 0, 1, 2; the last part orders roles that could change places (larger id first).
TYPES = {
    0: ([("one", 0, 1), ("one", 0, 2), ("one", 1, 2)], []),
    1: ([("one", 0, 1), ("one", 2, 0), ("one", 1, 2)], [(0, 1), (0, 2)]),
    2: ([("two", 0, 1), ("one", 2, 0), ("one", 1, 2)], []),
    3: ([("two", 0, 1), ("one", 2, 0), ("one", 2, 1)], [(0, 1)]),
    4: ([("two", 0, 1), ("one", 0, 2), ("one", 1, 2)], [(0, 1)]),
    5: ([("one", 0, 1), ("two", 0, 2), ("two", 1, 2)], []),
    6: ([("two", 0, 1), ("two", 1, 2), ("two", 0, 2)], [(0, 1), (1, 2)]),
}
NAMES = "ABCDEFG"


def directed_adjacency(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., node, nbr, dir): out and in of one-way edges, bi at both ends of two-way ones."""
    ends = F.when(F.col("bi"), F.array(*[F.struct(F.col(a).alias("node"), F.col(b).alias("nbr"), F.lit("bi").alias("dir")) for a, b in (("s", "d"), ("d", "s"))])).otherwise(
        F.array(F.struct(F.col("s").alias("node"), F.col("d").alias("nbr"), F.lit("out").alias("dir")), F.struct(F.col("d").alias("node"), F.col("s").alias("nbr"), F.lit("in").alias("dir")))
    )
    return edges.select(*by, F.explode(ends).alias("e")).select(*by, "e.*")


def adjacency_lists(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by..., node, dir, nbrs): distinct neighbours by direction, sorted."""
    return directed_adjacency(edges, by).groupBy(*by, "node", "dir").agg(F.sort_array(F.collect_set("nbr")).alias("nbrs"))


def relation_pairs(frequencies: DataFrame, by: list[str]) -> DataFrame:
    """(by..., s, d, down, up, two) with s > d: one-way edges from the larger to the smaller id, back, and two-way ones."""
    down = (~F.col("bi")) & (F.col("s") > F.col("d"))
    up = (~F.col("bi")) & (F.col("s") < F.col("d"))
    total = lambda keep: F.sum(F.when(keep, F.col("f")).otherwise(F.lit(0)))
    return frequencies.groupBy(*by, F.greatest("s", "d").alias("hi"), F.least("s", "d").alias("lo")).agg(total(down).alias("down"), total(up).alias("up"), total(F.col("bi")).alias("two")).withColumnsRenamed({"hi": "s", "lo": "d"})


def _matches(type_: int, weighted: bool) -> Column:
    """Matches of a type on a candidate whose pairs, by falling ids, are p[0] = (x, y), p[1] = (x, z), p[2] = (y, z)."""
    edges, order = TYPES[type_]
    pair = {(0, 1): 0, (0, 2): 1, (1, 2): 2}

    def number(kind: str, a: int, b: int) -> Column:
        p = F.col("p")[pair[min(a, b), max(a, b)]]
        n = p["two"] if kind == "two" else p["down"] if a < b else p["up"]
        return n if weighted else (n > 0).cast("long")

    out: Column = F.lit(0).cast("long")
    for place in permutations(range(3)):  # role -> rank of its node; rank 0 is the largest id
        if all(place[i] < place[j] for i, j in order):
            n = [number(kind, place[i], place[j]) for kind, i, j in edges]
            out = out + n[0] * n[1] * n[2]
    return out


def typed(found: DataFrame, types: list[int], keep: list[str]) -> DataFrame:
    """(keep..., nodes, type, n, weighted) for each candidate and type that it has: distinct pairs, and choices of instances."""
    pairs = found.select(*keep, F.array("a", "b", "c").alias("nodes"), F.sort_array(F.array("ab", "ac", "bc"), asc=False).alias("p"))
    each = F.array(*[F.struct(F.lit(k).alias("type"), _matches(k, False).alias("n"), _matches(k, True).alias("weighted")) for k in types])
    return pairs.select(*keep, "nodes", F.explode(each).alias("m")).select(*keep, "nodes", "m.*").where("n > 0")


def _candidates(frequencies: DataFrame, by: list[str]) -> DataFrame:
    return triangles(relation_pairs(frequencies, by), by, ["down", "up", "two"])


def directed_triangle_count(frequencies: DataFrame, by: list[str], weighted: bool = False, types: list[int] | None = None, every: DataFrame | None = None) -> DataFrame:
    """(by..., type, triangles) of the asked types, all seven by default, in one pass."""
    types = list(TYPES) if types is None else types
    found = typed(_candidates(frequencies, by), types, by).groupBy(*by, "type").agg(F.sum("weighted" if weighted else "n").alias("triangles"))
    if every is None:
        return found
    rows = every.select(*by, F.explode(F.array(*[F.lit(k) for k in types])).alias("type"))
    return rows.join(found, [*by, "type"], "left").withColumn("triangles", F.coalesce("triangles", F.lit(0).cast("long")))


def directed_local_count(frequencies: DataFrame, by: list[str], weighted: bool = False, types: list[int] | None = None) -> DataFrame:
    """(by..., type, node, triangles) for every node and asked type."""
    types = list(TYPES) if types is None else types
    found = typed(_candidates(frequencies, by), types, by).select(*by, "type", F.col("weighted" if weighted else "n").alias("n"), F.explode("nodes").alias("node"))
    nodes = frequencies.select(*by, F.explode(F.array("s", "d")).alias("node")).distinct()
    none = nodes.select(*by, F.explode(F.array(*[F.lit(k) for k in types])).alias("type"), F.lit(0).cast("long").alias("n"), "node")
    return found.unionByName(none).groupBy(*by, "type", "node").agg(F.sum("n").alias("triangles"))


def local_count_a(frequencies: DataFrame, by: list[str], weighted: bool = False) -> DataFrame:
    return directed_local_count(frequencies, by, weighted, [0])


def local_count_b(frequencies: DataFrame, by: list[str], weighted: bool = False) -> DataFrame:
    return directed_local_count(frequencies, by, weighted, [1])
