"""What is moved between tasks, and hubs, in the exact counts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from trellisway.operators import changes as ch
from trellisway.operators import estimators as es
from trellisway.operators import sampling as sm
from trellisway.operators import triangles as tr
from trellisway.operators import window as wd
from trellisway.operators.prepare import WindowSpec, checkpoints, prepared
from trellisway.operators.triangles import meeting_nodes
from trellisway.sources.edges import copurchase_edges, copurchase_parts


def _brute(pairs):
    held = set(pairs)
    nodes = sorted({n for p in pairs for n in p})
    return sorted(t for t in itertools.combinations(nodes, 3) if all((max(p), min(p)) in held for p in itertools.combinations(t, 2)))


@pytest.mark.parametrize("least", [0, 4, 12])
def test_nodes_of_triangles_with_hubs(spark, least):
    draw = random.Random(least)
    pairs = sorted({(max(p), min(p)) for p in ((draw.randrange(25), draw.choice([1, 2, draw.randrange(25)])) for _ in range(140)) if p[0] != p[1]})
    degree = {n: sum(n in p for p in pairs) for p in pairs for n in p}
    hubs = spark.createDataFrame([(0, n, k) for n, k in degree.items() if k > least] or [(0, -1, 1)], "g int, node long, n long")
    rows = spark.createDataFrame([(0, *p) for p in pairs * 2], "g int, s long, d long")
    assert sorted(tuple(sorted(r)) for r in meeting_nodes(rows, ["g"], hubs).select("a", "b", "c").collect()) == _brute(pairs)


def test_paths_are_no_rows(spark):
    """A count's plan reads nodes that meet from a table and joins no pairs of pairs."""
    rows = spark.createDataFrame([(i, i, i % 5 + 6, i % 6) for i in range(60)], "eid long, t long, s long, d long")
    plan = ch.triangle_count(rows, WindowSpec(20, 2), weighted=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "degree_" not in plan


def test_pairs_of_an_order_stay_in_its_task(spark):
    """Lines are shuffled by their order; pairs are not."""
    plan = copurchase_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert all(f"hashpartitioning({c}" not in plan for c in ("la", "lb")) and plan.count("Exchange hashpartitioning") <= 2, plan


def test_common_neighbours_go_to_checkpoints_last(spark):
    """Pairs meet their triangles' nodes as spans; checkpoints come after the last shuffle, and no neighbour is a row for each pair."""
    rows = spark.createDataFrame([(i, i, i % 5 + 6, i % 6) for i in range(60)], "eid long, t long, s long, d long")
    plan = ch.common_neighbors(rows, WindowSpec(20, 2))._jdf.queryExecution().executedPlan().toString()
    assert "_near" not in plan and "explode(sequence(start" in plan.split("Exchange")[0], plan


def test_what_is_asked_twice_is_found_once(spark):
    rows = spark.createDataFrame([(i, i, *((3, 1), (2, 1), (3, 2))[i % 3]) for i in range(60)], "eid long, t long, s long, d long")
    asked = lambda *spans: spark.createDataFrame([(2, 3, *p) for p in spans], "x long, y long, cp_from long, cp_to long")
    once, twice = (sorted(map(tuple, ch.common_neighbors(rows, WindowSpec(20, 2), asked(*p)).collect())) for p in ([(3, 30)], [(3, 9), (5, 12), (6, 7), (12, 30)]))
    assert once == twice and [r[0] for r in once] == list(range(3, 31)) and all(r[5] == [1] for r in once if r[3])


def test_an_order_s_pairs_are_sorted_once(spark):
    plan = copurchase_edges(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "lb" in line for line in plan.splitlines()) == 1, plan


def test_draws_are_not_made_again_and_few_edges_are_sorted(spark):
    """No filter asks for nulls by working out draws; checkpoints are found by hash, and only edges at their group's bound are sorted."""
    rows = spark.createDataFrame([(k, k % 100, k % 9 + 10, k % 10) for k in range(400)], "eid long, t long, s long, d long")
    states = sm.slot_states(sm.replicate(rows, 2), WindowSpec(40, 10), sm.SampleSpec(40, 3, 8))
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert not any("48271" in line for line in plan.splitlines() if "Filter" in line), plan
    assert ">= least" in plan, plan
    firsts = checkpoints(rows, 10)._jdf.queryExecution().executedPlan().toString()
    assert "functions=[partial_min(eid" in firsts and firsts.count("HashAggregate") == 2, firsts


def test_tops_with_equal_priorities(spark):
    """Draws of two values, so most places have ties: the later arrival is the top."""
    spec, step, draw = sm.SampleSpec(40, 2, 3), 10, random.Random(5)
    edges = [(k, draw.randrange(100), draw.randrange(2), draw.randrange(2), draw.randrange(3)) for k in range(300)]
    slotted = spark.createDataFrame([(0, k, t, p, g, x, (t - (g - 2) * 20) // 40, k, -k) for k, t, p, g, x in edges], "seed int, eid long, t long, priority long, grp long, slot long, slice long, s long, d long")
    points = checkpoints(slotted, step)
    want = set()
    for c in points.collect():
        for g, x in itertools.product(range(2), range(3)):
            now = (c.cp_t - (g - 2) * 20) // 40
            top = lambda n: max([(p, t, k) for k, t, p, gg, xx in edges if (gg, xx) == (g, x) and (t - (g - 2) * 20) // 40 == n and (t, k) <= (c.cp_t, c.cp_eid)], default=None)  # noqa: E731, B023
            if top(now) or top(now - 1):
                want.add((c.cp, g, x, top(now - 1), top(now)))
    got = {(r.cp, r.grp, r.slot, r.a and tuple(r.a)[:3], r.b and tuple(r.b)[:3]) for r in sm.slots_at(slotted, points, spec, step, ["s", "d"]).collect()}
    assert got == want and len(want) > 40


def test_an_estimate_finds_its_checkpoints_once(spark):
    rows = spark.createDataFrame([(k, k % 100, k % 9 + 10, k % 10) for k in range(400)], "eid long, t long, s long, d long")
    plan = es.swtc_estimate(sm.replicate(rows, 2), WindowSpec(40, 10), sm.SampleSpec(40, 3, 8))._jdf.queryExecution().optimizedPlan().toString()
    assert "min(struct" not in plan and "min(eid" not in plan, plan


def test_lines_are_read_for_tables_alone(spark):
    """Edges and their first time come from tables; no plan makes pairs of lines anew, and plain orders' pairs are not sorted."""
    edges = prepared(copurchase_edges(spark, "/root/testdata/sf0.001"))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "_origin" not in plan, plan
    plain, odd = copurchase_parts(spark, "/root/testdata/sf0.001")
    executed = plain._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in executed and "Exchange" not in executed, executed


def test_places_of_equal_lines(spark, tmp_path):
    """Copies are numbered by time and both parts, also where lines of one number have equal times and parts."""
    draw = random.Random(3)
    lines = [(k, draw.randrange(1, 4), draw.choice([None, 1, 2, 3]), draw.choice([None, *range(3)])) for k in range(60) for _ in range(draw.randrange(1, 12))]
    rows = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, day int")
    rows.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "date_add(DATE '1995-01-01', day) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    key = lambda p: [(v is not None, v or 0) for v in p]
    want = set()
    for k in range(60):
        own = [x[1:] for x in lines if x[0] == k]
        for la, lb in itertools.combinations((1, 2, 3), 2):
            pairs = sorted(((a[2], a[1], b[1]) for a in own for b in own if (a[0], b[0]) == (la, lb)), key=key)
            want |= {(((k * 8 + la) * 8 + lb) * 32 + i, *p) for i, p in enumerate(pairs, 1)}
    plain, odd = copurchase_parts(spark, str(tmp_path))
    got = [tuple(r) for r in plain.unionByName(odd).collect()]
    assert len(got) == len(set(got)) and set(got) == want and plain.count() > odd.count() > 0


def test_bounds_come_from_few_edges(spark):
    """Places of many edges: an eighth of these give the bound, which leaves the same tops."""
    spec, step, draw = sm.SampleSpec(40, 2, 2), 40, random.Random(8)
    edges = [(k, k // 40, draw.randrange(200), draw.randrange(2), draw.randrange(2)) for k in range(4000)]
    slotted = spark.createDataFrame([(0, k, t, p, g, x, (t - (g - 2) * 20) // 40, k, -k) for k, t, p, g, x in edges], "seed int, eid long, t long, priority long, grp long, slot long, slice long, s long, d long")
    points = checkpoints(slotted, step)
    want = set()
    for c in points.collect():
        for g, x in itertools.product(range(2), range(2)):
            now = (c.cp_t - (g - 2) * 20) // 40
            top = lambda n: max([(p, t, k) for k, t, p, gg, xx in edges if (gg, xx) == (g, x) and (t - (g - 2) * 20) // 40 == n and (t, k) <= (c.cp_t, c.cp_eid)], default=None)  # noqa: E731, B023
            want.add((c.cp, g, x, top(now - 1), top(now)))
    states = sm.slots_at(slotted, points, spec, step, ["s", "d"])
    assert {(r.cp, r.grp, r.slot, r.a and tuple(r.a)[:3], r.b and tuple(r.b)[:3]) for r in states.collect()} == want
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "places" in plan, plan


def test_ends_of_equal_bits_make_no_triangle(spark):
    """Paths tell far ends apart by 16 bits; what only looks like a pair is no triangle."""
    bits = spark.range(10, 4000).selectExpr("id", "shiftright(xxhash64(id), 48) AS bits")
    like = bits.groupBy("bits").agg(F.min("id").alias("one"), F.max("id").alias("two")).where("one < two").first()
    rows = lambda pairs: spark.createDataFrame([(k, t, a, b) for t in (0, 2, 4, 6) for k, (a, b) in enumerate(pairs, 10 * t)], "eid long, t long, s long, d long")
    count = lambda *pairs: {r.triangles for r in ch.triangle_count(rows(pairs), WindowSpec(20, 2)).collect()}
    path = [(2, 1), (like.one, 1), (like.two, 2)]
    assert count(*path) == {0}
    assert max(count(*path, (like.one, 2))) == 1
    near = meeting_nodes(spark.createDataFrame([(0, *p) for p in path], "g int, s long, d long"), ["g"], spark.createDataFrame([], "g int, node long, n long"))
    assert [tuple(r) for r in near.select("a", "b", "c").collect()] == [(1, 2, like.two)]


def test_pairs_and_their_triangles_are_shuffled_once(spark):
    """Counts of pairs are made where spans and triangles have come to; they equal those of each window's graph."""
    draw = random.Random(4)
    rows = spark.createDataFrame([(k, k // 3, a, b) for k, (a, b) in enumerate((draw.randrange(4, 12), draw.randrange(4)) if k % 2 else (draw.randrange(2, 4), draw.randrange(2)) for k in range(240))], "eid long, t long, s long, d long")
    spec = WindowSpec(20, 4)
    counts = ch.edge_triangle_count(rows, spec)
    want = tr.edge_triangle_count(wd.edge_frequencies(wd.window_edges(rows, spec), ["cp"]), ["cp"])
    key = lambda df: sorted(tuple(r) for r in df.select("cp", "s", "d", "triangles").collect())
    assert key(counts) == key(want) and any(r[3] > 1 for r in key(want))
    last = counts._jdf.queryExecution().executedPlan().toString().split("Union")[0]
    assert last.count("Exchange") == 1, last


def test_neighbours_are_shuffled_as_plain_rows(spark):
    """No list is made before the last shuffle."""
    rows = spark.createDataFrame([(i, i, i % 5 + 6, i % 6) for i in range(60)], "eid long, t long, s long, d long")
    plan = ch.common_neighbors(rows, WindowSpec(20, 2))._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan.split("Exchange", 1)[1], plan
