"""Streams against batches, files against their order, and moments against each edge."""

import os
import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from trellisway.functions.materialize import shared_folder, stored, temporary_tables
from trellisway.operators import changes as ch
from trellisway.operators import estimators as es
from trellisway.operators import moments as mo
from trellisway.operators import prepare as pr
from trellisway.operators import sampling as sm
from trellisway.operators import triangles as tr
from trellisway.operators import window as wd
from trellisway.sources import edges as src
from trellisway.streaming import batches, deltas, jobs
from trellisway.streaming import lives as lv

W, STEP = 40, 10
WSPEC, SPEC = pr.WindowSpec(W, STEP), sm.SampleSpec(W, 3, 8)
SCHEMA = "eid long, t long, s long, d long"


def rows_of(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=repr)


def random_rows(seed, n=260, nodes=11):
    """In order of arrival, with equal times, gaps and bursts."""
    rng, rows, t = random.Random(seed), [], 0
    for k in range(n):
        t += rng.choice([0, 0, 1, 1, 2, 30 if k % 90 == 89 else 1])
        s, d = rng.sample(range(nodes), 2)
        rows.append((k, t, max(s, d), min(s, d)))
    return rows


def as_files(spark, parts):
    folder = batches.new_folder(spark, "source")
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    return jobs.read_stream(spark, folder)


def thirds(rows, cuts=(70, 150, 152)):
    return [rows[a:b] for a, b in zip((0, *cuts), (*cuts, len(rows)), strict=True)]


# ---------------------------------------------------------------- order of arrival


@pytest.mark.parametrize("split", ["64", "1m"])
def test_lines_are_numbered_as_they_lie(spark, tmp_path, split):
    lines, n = [], 0
    os.makedirs(f"{tmp_path}/in")
    for name, many in (("a", 90), ("b", 0), ("c", 1), ("d", 40)):
        with open(f"{tmp_path}/in/{name}.txt", "w") as file:
            for _ in range(many):
                lines.append((n, n % 7, n // 9, 5 * n))
                file.write(f"{n % 7} {n // 9} 3 {5 * n}\n")
                n += 1
    with open(f"{tmp_path}/in/e.txt", "w") as file:
        file.write("1 2 0 x\n\n4 5 0 999\n")
    lines.append((n, 4, 5, 999))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        got = [tuple(r) for r in src.read_edges(spark, f"{tmp_path}/in").orderBy("eid").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == lines


def test_ids_and_ways_of_tables_are_kept(spark, tmp_path):
    spark.createDataFrame([(7, 1, 2, 3, True)], "eid long, s long, d long, t long, bi boolean").write.parquet(f"{tmp_path}/a")
    assert [r.asDict() for r in src.read_edges(spark, f"{tmp_path}/a", directed=True, format="parquet").collect()] == [{"eid": 7, "s": 1, "d": 2, "t": 3, "bi": True}]
    spark.createDataFrame([(1, 2, 3), (2, 3, 3)], "s long, d long, t long").coalesce(1).write.parquet(f"{tmp_path}/b")
    assert sorted((r.eid, r.s, r.bi) for r in src.read_edges(spark, f"{tmp_path}/b", directed=True, format="parquet").collect()) == [(0, 1, False), (1, 2, False)]
    assert src.read_edges(spark, f"{tmp_path}/b", format="parquet").where("s > 5").collect() == []


def test_written_lines_come_back_in_order(spark, tmp_path):
    rows = random_rows(3)
    df = spark.createDataFrame(random.Random(1).sample(rows, len(rows)), SCHEMA).repartition(5)
    src.write_edges(df, f"{tmp_path}/lines")
    got = src.read_edges(spark, f"{tmp_path}/lines").orderBy("eid").select("eid", "t", "s", "d").collect()
    assert [tuple(r) for r in got] == rows


# ---------------------------------------------------------------- streams


def exact(spark, edges):
    points = pr.checkpoints(edges, STEP)
    counts = tr.triangle_count(wd.edge_frequencies(wd.window_edges(edges, WSPEC), ["cp"]), ["cp"], True, points)
    return sorted(tuple(r) for r in points.join(counts, "cp").select("bucket", "cp_t", "triangles").collect())


@pytest.mark.parametrize("sum_up_after", [1, 2, 32])
def test_counts_by_deltas_are_those_of_the_window(spark, sum_up_after):
    rows = random_rows(5)
    folder = batches.new_folder(spark, "counts")
    parts = [*thirds(rows), [(9000, rows[-1][1] + 3 * W, 1, 0)], [(9001, rows[-1][1] + 3 * W + 1, 2, 0), (9002, rows[-1][1] + 3 * W + 12, 2, 1), (9003, rows[-1][1] + 3 * W + 30, 2, 1)]]
    deltas.stream_exact_counts(as_files(spark, parts), WSPEC, folder, sum_up_after=sum_up_after).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/counts").select("bucket", "cp_t", "triangles").collect())
    assert got == exact(spark, spark.createDataFrame([r for p in parts for r in p], SCHEMA)) and sum(r[2] for r in got) > 0
    assert batches.dropped_edges(spark, folder) == 0


def test_a_batch_may_run_again(spark):
    rows = random_rows(6)
    stream, folder = as_files(spark, thirds(rows)), batches.new_folder(spark, "counts")
    start = lambda: deltas.stream_exact_counts(stream, WSPEC, folder, sum_up_after=2)
    start().awaitTermination()
    commits = f"{folder}/state/commits".removeprefix("file:")
    os.remove(f"{commits}/3")
    for name in os.listdir(commits):
        if name.startswith(".3"):
            os.remove(f"{commits}/{name}")
    start().awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{folder}/counts").select("bucket", "cp_t", "triangles").collect())
    assert got == exact(spark, spark.createDataFrame(rows, SCHEMA))


def test_late_edges_are_held_back_or_counted_as_dropped(spark):
    rows = random_rows(7)
    parts = thirds(rows)
    parts[0], parts[1], moved = parts[0][:-3], [*parts[0][-3:], *parts[1]], parts[0][-3:]
    parts[2].append(rows[0])
    folder, late = batches.new_folder(spark, "late"), 15
    deltas.stream_exact_counts(as_files(spark, parts), WSPEC, folder, late=late).awaitTermination()
    newest = rows[-1][1]
    want = [r for r in exact(spark, spark.createDataFrame(rows, SCHEMA)) if r[1] < newest - late]
    assert sorted(tuple(r) for r in spark.read.parquet(f"{folder}/counts").select("bucket", "cp_t", "triangles").collect()) == want
    assert batches.dropped_edges(spark, folder) == 1 and moved
    strict = batches.new_folder(spark, "strict")
    deltas.stream_exact_counts(as_files(spark, [rows[10:20], rows[:10], rows[20:]]), WSPEC, strict).awaitTermination()
    assert batches.dropped_edges(spark, strict) == 10


@pytest.mark.parametrize("late", [None, 12])
def test_estimates_of_streams_are_those_of_batches(spark, late):
    rows = random_rows(8)
    edges = spark.createDataFrame(rows, SCHEMA)
    seeded = sm.replicate(edges, 2)
    points = {r.cp: r.bucket for r in pr.checkpoints(edges, STEP).collect() if late is None or r.cp_t < rows[-1][1] - late}
    for start, whole in ((lambda f: jobs.stream_cbs_estimate(as_files(spark, thirds(rows)), WSPEC, SPEC, 2, f, slices=4, late=late), es.cbs_estimate(seeded, WSPEC, SPEC, 4)), (lambda f: jobs.stream_swtc_estimate(as_files(spark, thirds(rows)), WSPEC, SPEC, 2, f, late=late), es.swtc_estimate(seeded, WSPEC, SPEC))):
        folder = batches.new_folder(spark, "estimates")
        start(folder).awaitTermination()
        got = {(r.seed, r.bucket): r.estimate for r in spark.read.parquet(f"{folder}/estimates").collect()}
        want = {(r.seed, points[r.cp]): pytest.approx(r.estimate) for r in whole.collect() if r.cp in points}
        assert got == want and len(got) > 10


def test_lives_from_events_are_those_of_the_batch(spark):
    rows = random_rows(9)
    edges = spark.createDataFrame(rows, SCHEMA)
    stream = as_files(spark, [*thirds(rows), [(-1, rows[-1][1] + 10 * W, -1, -1)]])
    events = jobs.run_through(lv.stream_life_events(stream, SPEC, 2), spark, conf=lv.STORE)
    want = sm.sample_lifetimes(sm.replicate(edges, 2), SPEC).drop("slice")
    assert rows_of(lv.lives_of_events(events, edges, SPEC)) == rows_of(want)
    assert {r.event for r in events.select("event").distinct().collect()} == {"started", "promoted", "replaced", "expired"}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != next(iter(lv.STORE.values()))


# ---------------------------------------------------------------- moments, and counts without copies


def test_any_moment_is_answered_from_one_folder(spark):
    rows = random_rows(10, n=120)
    rows = [(k, t + (400 if t > 60 else 0), s, d) for k, t, s, d in rows]  # a gap of several chunks
    path = batches.new_folder(spark, "moments")
    mo.write_moments(spark.createDataFrame(rows, SCHEMA), W, path, chunk=25)
    times = [-3, 0, 1, 24, 25, 26, 59, 200, 399, 401, 470, 500, 10**6]
    asked = spark.createDataFrame([(x,) for x in [*times, 25]], "asked long")
    counts = mo.counts_at(path, asked)
    got, pairs = {r.asked: r for r in counts.collect()}, {}
    for r in mo.pairs_at(path, asked).collect():
        pairs.setdefault(r.asked, Counter())[r.s, r.d] = r.f
    assert sorted(got) == times
    for x in times:
        now = max((t for _, t, _, _ in rows if t <= x), default=None)
        f = Counter((s, d) for _, t, s, d in rows if now is not None and now - W <= t <= now)
        nodes = sorted({v for p in f for v in p}, reverse=True)
        triangles = sum(f[a, b] * f[a, c] * f[b, c] for a, b, c in combinations(nodes, 3))
        assert (got[x].t, got[x].instances, got[x].distinct_edges, got[x].triangles) == (now, sum(f.values()), len(f), triangles)
        assert pairs.get(x, Counter()) == f
    plan = mo.counts_at(path, spark.createDataFrame([(30,)], "asked long"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(chunk" in plan and "(chunk" in plan and "= 1)" in plan
    nothing = batches.new_folder(spark, "moments")
    mo.write_moments(spark.createDataFrame([], SCHEMA), W, nothing)
    assert [tuple(r) for r in mo.counts_at(nothing, spark.createDataFrame([(1,)], "asked long")).collect()] == [(1, None, 0, 0, 0)]
    assert mo.pairs_at(nothing, asked).collect() == []


def test_wedges_and_neighbours_by_changes(spark):
    edges = spark.createDataFrame(random_rows(12), SCHEMA)
    freq = wd.edge_frequencies(wd.window_edges(edges, WSPEC), ["cp"])
    assert rows_of(ch.wedge_count(edges, WSPEC)) == rows_of(tr.wedge_count(freq, ["cp"]))
    own = ch.common_neighbors(edges, WSPEC)
    assert rows_of(own) == rows_of(tr.common_neighbors(freq, freq.select("cp", F.col("s").alias("x"), F.col("d").alias("y")), ["cp"]))
    plan = ch.wedge_count(edges, WSPEC)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan
    asked = spark.createDataFrame([(3, 4, 2, 6), (500, 1, 1, 3)], "x long, y long, cp_from long, cp_to long")
    pairs = asked.select(F.explode(F.sequence("cp_from", "cp_to")).alias("cp"), "x", "y")
    assert rows_of(ch.common_neighbors(edges, WSPEC, asked)) == rows_of(tr.common_neighbors(freq, pairs, ["cp"]))


def test_the_smaller_neighbourhood_is_gone_through(spark):
    """A hub of 400 and a node of 3 that share 2: no more than 3 rows are made for the pair, which ever way it is asked."""
    pairs = spark.createDataFrame([(1000, k, 1) for k in range(400)] + [(2000, 5, 2), (2000, 7, 1), (2001, 2000, 1)], "s long, d long, f long")
    asked = spark.createDataFrame([(1000, 2000), (2000, 1000)], "x long, y long")
    found = tr.neighbours_of_both(pairs, asked, [], [])
    assert rows_of(found.select("x", "z", "f_x", "f_y")) == [(1, 2, 1000, 5), (1, 1, 1000, 7), (2, 1, 2000, 5), (1, 1, 2000, 7)] or sorted(map(tuple, found.select("x", "z", "f_x", "f_y").collect())) == [(1000, 5, 1, 2), (1000, 7, 1, 1), (2000, 5, 2, 1), (2000, 7, 1, 1)]


def test_hubs_are_split_and_others_left_alone(spark):
    left = spark.createDataFrame([(1 if k % 3 else k, k) for k in range(300)], "node long, x long")
    right = spark.createDataFrame([(1 if k % 2 else k, k) for k in range(100)], "node long, y long")
    plain, split = left.join(right, "node"), es.salted_join(left, right, ["node"], 500)
    assert rows_of(split) == rows_of(plain) and split.columns == plain.columns
    loads = Counter(r.p for r in split.repartition(64, "x").select(F.pmod(F.xxhash64("x"), F.lit(64)).alias("p")).collect())
    assert max(loads.values()) < plain.count() / 4


def test_a_burst_of_edges_is_summed_in_many_ranges(spark):
    """Half of the edges arrive at one time."""
    rows = random_rows(13, n=120)
    burst = [(k + 1000, rows[-1][1] + 1, (k * 7) % 11 + 11, (k * 3) % 11) for k in range(120)]
    seeded = sm.replicate(spark.createDataFrame([*rows, *burst], SCHEMA), 1)
    before = {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("table-")}
    sized = es.pair_probability(seeded, stored(sm.sample_lifetimes(seeded, SPEC)), SPEC)
    assert sized.where("kind = 3").count() == 240
    new = {f for f in os.listdir(shared_folder(spark).removeprefix("file:")) if f.startswith("table-")} - before
    steps = [t for f in new if "chunk" in (t := spark.read.parquet(f"{shared_folder(spark)}/{f}")).columns and "valid_0" in t.columns]
    sizes = [r["count"] for r in steps[0].where(F.col("at.t") == rows[-1][1] + 1).groupBy("chunk").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 0.6 * sum(sizes)


def test_temporary_tables_go(spark):
    with temporary_tables(spark):
        path = stored(spark.range(3)).inputFiles()[0].removeprefix("file:")
        assert os.path.exists(path)
    assert not os.path.exists(path)
    kept = stored(spark.range(3))
    assert kept.count() == 3
