"""Hand graphs with known counts, and sums that hold on any graph."""

import random

import pytest
from pyspark.sql import functions as F

from trellisway.operators import changes as ch
from trellisway.operators import directed as dg
from trellisway.operators import prepare as pr
from trellisway.operators import triangles as tr
from trellisway.operators import window as wd


def edges(spark, rows):
    """(s, d[, t[, bi]]) in order of arrival."""
    full = [(k, r[2] if len(r) > 2 else 0, r[0], r[1], r[3] if len(r) > 3 else False) for k, r in enumerate(rows)]
    return spark.createDataFrame(full, "eid long, t long, s long, d long, bi boolean")


def frequencies(spark, rows, directed=False):
    return wd.edge_frequencies(pr.prepared(edges(spark, rows), directed).withColumn("cp", F.lit(1)), ["cp"], directed)


def one(df, column="triangles"):
    found = df.collect()
    return found[0][column] if found else 0


GRAPHS = {
    "triangle": ([(1, 2), (2, 3), (1, 3)], 1, 1, 3),
    "repeated": ([(1, 2), (1, 2), (2, 3), (2, 3), (2, 3), (1, 3)], 1, 6, 3),
    "k4": ([(1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4)], 4, 4, 12),
    "square": ([(1, 2), (2, 3), (3, 4), (4, 1)], 0, 0, 4),
    "reversed": ([(1, 2), (2, 1), (2, 3), (1, 3)], 1, 2, 3),
    "node 0": ([(0, 1), (1, 2), (0, 2)], 1, 1, 3),
    "loop": ([(5, 5, 0), (1, 2, 7), (2, 3, 8), (1, 3, 9)], 1, 1, 3),
}


@pytest.mark.parametrize("name", GRAPHS)
def test_hand_graphs(spark, name):
    rows, plain, weighted, wedges = GRAPHS[name]
    freq = frequencies(spark, rows)
    assert one(tr.triangle_count(freq, ["cp"])) == plain
    assert one(tr.triangle_count(freq, ["cp"], weighted=True)) == weighted
    assert one(tr.wedge_count(freq, ["cp"]), "wedges") == wedges
    if name == "square":
        assert {r.node: r.triangles for r in tr.local_triangle_count(freq, ["cp"]).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
        assert [r.triangles for r in tr.edge_triangle_count(freq, ["cp"]).collect()] == [0] * 4
    if name == "loop":
        assert pr.prepared(edges(spark, rows)).agg(F.min("t")).first()[0] == 0


TYPED = {
    0: [(1, 2), (1, 3), (2, 3)],
    1: [(1, 2), (2, 3), (3, 1)],
    2: [(1, 2, 0, True), (3, 1), (2, 3)],
    3: [(1, 2, 0, True), (3, 1), (3, 2)],
    4: [(1, 2, 0, True), (1, 3), (2, 3)],
    5: [(1, 2), (1, 3, 0, True), (2, 3, 0, True)],
    6: [(1, 2, 0, True), (2, 3, 0, True), (1, 3, 0, True)],
}


@pytest.mark.parametrize("type_", TYPED)
def test_directed_types(spark, type_):
    found = {r.type: r.triangles for r in dg.directed_triangle_count(frequencies(spark, TYPED[type_], True), ["cp"]).collect()}
    assert found == {type_: 1}


def test_opposite_arrows_are_no_two_way_edge(spark):
    freq = frequencies(spark, [(1, 2), (2, 1), (2, 3), (1, 3)], True)
    assert {r.type: r.triangles for r in dg.directed_triangle_count(freq, ["cp"]).collect()} == {0: 2}


def test_window_is_closed_and_ties_are_by_arrival(spark):
    w = pr.WindowSpec(10, 5)
    rows = edges(spark, [(1, 2, 0), (2, 3, 5), (1, 3, 10), (4, 5, 10), (6, 7, 11)])
    seen = {(r.cp, r.eid) for r in wd.window_edges(rows, w).collect()}
    # checkpoints: t = 5 (eid 1) and t = 10 (eid 2); the edge at 0 is alive at 10, the second one at 10 isn't seen yet
    assert seen == {(1, 0), (1, 1), (2, 0), (2, 1), (2, 2)}
    late = edges(spark, [(1, 2, 0), (2, 3, 11), (1, 3, 12)])
    assert {(r.cp, r.eid) for r in wd.window_edges(late, w).collect()} == {(1, 1)}


def test_a_gap_gives_one_checkpoint(spark):
    assert [r.bucket for r in pr.checkpoints(edges(spark, [(1, 2, 0), (2, 3, 35)]), 10).collect()] == [3]


def test_empty_streams(spark):
    none = edges(spark, [(1, 2)]).limit(0)
    w = pr.WindowSpec(10, 5)
    assert wd.window_edges(none, w).count() == 0
    assert ch.window_deltas(none, w).count() == 0
    assert ch.local_triangle_count(none, w).count() == 0
    assert ch.triangle_census(none, w).count() == 0
    assert tr.triangle_count(wd.edge_frequencies(wd.window_edges(none, w), ["cp"]), ["cp"]).count() == 0


def test_sums_and_other_routes(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(14), rng.randrange(14), t // 3, rng.random() < 0.3) for t in range(240)]
    w = pr.WindowSpec(30, 6)
    stream = pr.prepared(edges(spark, rows))
    freq = wd.edge_frequencies(wd.window_edges(stream, w), ["cp"])
    points = pr.checkpoints(stream, w.step)
    by_cp = lambda df: {r.cp: r.n for r in df.groupBy("cp").agg(F.sum("triangles").alias("n")).collect()}
    plain, weighted = (by_cp(tr.triangle_count(freq, ["cp"], k, points)) for k in (False, True))
    assert by_cp(tr.local_triangle_count(freq, ["cp"])) == {k: 3 * v for k, v in plain.items()}
    assert by_cp(tr.local_triangle_count(freq, ["cp"], True)) == {k: 3 * v for k, v in weighted.items()}
    assert by_cp(tr.edge_triangle_count(freq, ["cp"])) == {k: 3 * v for k, v in plain.items()}
    rows_of = lambda df: sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert by_cp(ch.window_deltas(stream, w)) == by_cp(ch.triangle_count(stream, w, weighted=True)) == weighted
    assert by_cp(ch.triangle_count(stream, w)) == plain
    for k in (False, True):
        assert rows_of(ch.local_triangle_count(stream, w, k)) == rows_of(tr.local_triangle_count(freq, ["cp"], k))
    assert rows_of(ch.edge_triangle_count(stream, w)) == rows_of(tr.edge_triangle_count(freq, ["cp"]))
    assert all(weighted[k] >= plain[k] for k in plain)
    arrows = pr.prepared(edges(spark, rows), True)
    typed = wd.edge_frequencies(wd.window_edges(arrows, w), ["cp"], True)
    for k in (False, True):
        assert rows_of(ch.directed_triangle_count(arrows, w, k)) == rows_of(dg.directed_triangle_count(typed, ["cp"], k, every=points))
        assert rows_of(ch.directed_local_count(arrows, w, k)) == rows_of(dg.directed_local_count(typed, ["cp"], k))
    assert rows_of(ch.edge_frequencies(stream, w)) == rows_of(freq) and rows_of(ch.edge_frequencies(arrows, w, directed=True)) == rows_of(typed)
    for sizes, f, e in ((ch.window_sizes(stream, w), freq, stream), (ch.window_sizes(arrows, w, directed=True), typed, arrows)):
        assert rows_of(sizes.select("cp", "distinct_edges")) == rows_of(wd.distinct_edge_count(f, ["cp"]))
        assert rows_of(sizes.select("cp", "instances")) == rows_of(wd.edge_instance_count(wd.window_edges(e, w), ["cp"]))
        assert rows_of(sizes.select("cp", "nodes")) == rows_of(wd.node_count(f, ["cp"]))
    every = {(r.cp, r.type, r.node): r.triangles for r in dg.directed_local_count(typed, ["cp"]).collect()}
    assert {(r.cp, 0, r.node): r.triangles for r in dg.local_count_a(typed, ["cp"]).collect()} == {k: v for k, v in every.items() if k[1] == 0}
