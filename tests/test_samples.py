"""Samples and estimates against small machines that follow the rules arrival by arrival."""

import math
import random
from collections import defaultdict
from datetime import date

import pytest
from pyspark.sql import functions as F

from trellisway.functions.mix import MODULUS
from trellisway.operators import changes as ch
from trellisway.operators import estimators as es
from trellisway.operators import prepare as pr
from trellisway.operators import sampling as sm
from trellisway.operators import scoring as sc
from trellisway.operators import triangles as tr
from trellisway.operators import window as wd
from trellisway.sources import edges as src

W, STEP = 40, 10
SPEC = sm.SampleSpec(W, 3, 8)
WSPEC = pr.WindowSpec(W, STEP)


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(11)
    rows, t = [], 0
    for k in range(220):
        t += rng.choice([0, 0, 1, 1, 2, 25 if k % 70 == 69 else 1])
        rows.append((k, t, rng.randrange(12), rng.randrange(12)))
    df = pr.prepared(spark.createDataFrame(rows, "eid long, t long, s long, d long"))
    return sm.replicate(df, 1).cache()


@pytest.fixture(scope="module")
def slotted(stream):
    return sorted(sm.assign_slots(stream, SPEC).collect(), key=lambda r: (r.t, r.eid))


def start(grp):
    return (grp - SPEC.groups) * (W // SPEC.groups)


class Machine:
    """The places, edge by edge: top of the slice before (a) and of the current one (b), and each place's valid edge."""

    def __init__(self):
        self.slice = [(0 - start(g)) // W for g in range(SPEC.groups)]
        self.a, self.b = {}, {}
        self.gone = set()  # edges that are out of the window

    def valid(self, place):
        a, b = self.a.get(place), self.b.get(place)
        top = b if a is None or (b is not None and b.priority >= a.priority) else a
        return top if top is not None and top.eid not in self.gone else None

    def places(self):
        return set(self.a) | set(self.b)

    def sample(self):
        return {p: v for p in self.places() if (v := self.valid(p)) is not None}

    def expire(self, edge):
        self.gone.add(edge.eid)

    def move(self, t):
        for g in range(SPEC.groups):
            now = (t - start(g)) // W
            if now > self.slice[g]:
                for s in range(SPEC.slots):
                    b = self.b.pop((g, s), None)
                    self.a.pop((g, s), None)
                    if b is not None and now == self.slice[g] + 1:
                        self.a[(g, s)] = b
                self.slice[g] = now

    def insert(self, edge):
        place = (edge.grp, edge.slot)
        if place not in self.b or edge.priority >= self.b[place].priority:
            self.b[place] = edge

    def estimate(self):
        n, total, m = 0, 0.0, SPEC.slots
        for g in range(SPEC.groups):
            tops = {s: max(x.priority for x in (self.a.get((g, s)), self.b.get((g, s))) if x is not None) for gg, s in self.places() if gg == g}
            q = m - len(tops) + sum(2.0 ** -(math.floor(-math.log2(1 - p / (MODULUS + 1))) + 1) for p in tops.values())
            valid = sum(1 for p in self.sample() if p[0] == g)
            n += valid
            if tops:
                card = SPEC.alpha * m * m / q
                if card < 2.5 * m and len(tops) < m:
                    card = -math.log(1 - len(tops) / m) * m
                total += card * valid / len(tops)
        return n, total

    def chances(self):
        n, e = self.estimate()
        inc = n / e * (n - 1) / (e - 1) if n > 1 and e > 1 else None
        return inc, inc * (n - 2) / (e - 2) if inc is not None and n > 2 and e > 2 else None


def test_priority_sample_is_that_of_the_machine(stream, slotted):
    points = {r.cp_eid: r.cp for r in pr.checkpoints(stream, STEP).collect()}
    machine, expected, sizes = Machine(), set(), {}
    for k, edge in enumerate(slotted):
        for old in slotted[:k]:
            if old.t < edge.t - W:
                machine.expire(old)
        machine.move(edge.t)
        machine.insert(edge)
        if edge.eid in points:
            cp = points[edge.eid]
            expected |= {(cp, *p, v.eid) for p, v in machine.sample().items()}
            sizes[cp] = machine.estimate()
    states = sm.slot_states(stream, WSPEC, SPEC)
    assert {(r.cp, r.grp, r.slot, r.eid) for r in sm.priority_sample_at(states).collect()} == expected
    for r in sm.edge_cardinality_estimate(states, SPEC).collect():
        assert (r.n, pytest.approx(r.edges)) == sizes[r.cp]


def test_counts_on_arrival_are_those_of_the_machine(stream, slotted):
    slices = 4
    length = W // slices
    points = {r.cp_eid: r.cp for r in pr.checkpoints(stream, STEP).collect()}
    machine, gains, lost, boundary, expected = Machine(), defaultdict(float), 0.0, 0, {}
    index = lambda t: math.ceil(t / length) - 1

    def closed(edge):
        sides = [defaultdict(list), defaultdict(list)]
        for v in machine.sample().values():
            for side, node in zip(sides, (edge.s, edge.d), strict=True):
                if node in (v.s, v.d):
                    side[v.d if v.s == node else v.s].append(v.t)
        return [(x, y) for other in sides[0] for x in sides[0][other] for y in sides[1].get(other, [])]

    for k, edge in enumerate(slotted):
        while edge.t - boundary > length:
            boundary, lost = boundary + length, 0.0
        for old in slotted[:k]:
            if old.t < edge.t - W and old.eid not in machine.gone:
                was = old.eid in {v.eid for v in machine.sample().values()}
                machine.expire(old)
                if was and old.t > boundary - W:
                    chance = machine.chances()[1]
                    lost += sum(1 / chance for _ in closed(old)) if chance else 0.0
        machine.move(edge.t)
        machine.insert(edge)
        chance = machine.chances()[0]
        for x, y in closed(edge):
            gains[index(min(x, y, edge.t))] += 1 / chance if chance else 0.0
        if edge.eid in points:
            now = max(index(edge.t), 0)
            total = sum(v for i, v in gains.items() if now - slices <= i <= now)
            expected[points[edge.eid]] = (total - lost, total)
    found = {r.cp: r.estimate for r in es.cbs_estimate(stream, WSPEC, SPEC, slices).collect()}
    plain = {r.cp: r.estimate for r in es.cbs_estimate(stream, WSPEC, SPEC, slices, correct=False).collect()}
    assert sum(v[1] for v in expected.values()) > 0 and any(a != b for a, b in expected.values())
    assert found == {k: pytest.approx(v[0]) for k, v in expected.items()}
    assert plain == {k: pytest.approx(v[1]) for k, v in expected.items()}


def test_a_sure_sample_gives_the_exact_count(stream):
    freq = wd.edge_frequencies(wd.window_edges(stream, WSPEC), ["cp"])
    exact = {r.cp: r.triangles for r in tr.triangle_count(freq, ["cp"], True, pr.checkpoints(stream, STEP)).collect()}
    assert {r.cp: r.estimate for r in es.fixed_p_estimate(stream, WSPEC, 1.0).collect()} == {k: float(v) for k, v in exact.items()}


def test_samples_and_the_exact_count_share_their_triangles(stream):
    """Estimates of several seeds and the exact count, from triangles that are found once."""
    exact = {r.cp: r.triangles for r in ch.triangle_count(stream, WSPEC, weighted=True).collect()}
    want = {(r.seed, r.cp): (r.estimate, exact[r.cp]) for r in es.fixed_p_estimate(sm.replicate(stream, 3), WSPEC, 0.7).collect()}
    both = es.fixed_p_and_exact(stream, WSPEC, 0.7, 3)
    assert {(r.seed, r.cp): (r.estimate, r.triangles) for r in both.collect()} == want and any(e for e, _ in want.values())
    # a seed of which no edge is sampled has estimates too
    assert {(r.seed, r.estimate) for r in es.fixed_p_and_exact(stream, WSPEC, 1e-9, 2).collect()} == {(0, 0.0), (1, 0.0)}


def test_estimates_are_near_the_exact_count_on_average(spark):
    rng = random.Random(5)
    rows = [(k, k // 4, rng.randrange(18), rng.randrange(18)) for k in range(900)]
    w, spec = pr.WindowSpec(100, 50), sm.SampleSpec(100, 4, 60)
    base = pr.prepared(spark.createDataFrame(rows, "eid long, t long, s long, d long"))
    exact = tr.triangle_count(wd.edge_frequencies(wd.window_edges(base, w), ["cp"]), ["cp"], True).agg(F.sum("triangles")).first()[0]
    total = es.swtc_estimate(sm.replicate(base, 12), w, spec).agg(F.sum("estimate")).first()[0] / 12
    assert abs(total - exact) < 0.25 * exact


def test_scores(spark):
    gold = spark.createDataFrame([(1, 10), (2, 20), (3, 0)], "cp long, triangles long")
    found = spark.createDataFrame([(0, 1, 11.0), (0, 2, 15.0), (0, 3, 3.0)], "seed int, cp long, estimate double")
    errors = sc.relative_error(found, gold, ["cp"])
    assert sorted((r.cp, None if r.error is None else round(r.error, 9)) for r in errors.collect()) == [(1, 0.1), (2, 0.25), (3, None)]
    run = sc.error_by_run(errors).first()
    assert (round(run.avg_error, 9), run.max_error, run.undefined) == (0.175, 0.25, 1)


def test_arrival_ids_differ_at_any_number_of_copies(spark, tmp_path):
    lines = [(ok, line, 10 * line + k, date(1995, 1, 2)) for ok in (1, 2, 9000) for line, n in ((1, 1), (2, 40), (3, 1), (9, 2), (10, 1)) for k in range(n)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_shipdate date").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [r.eid for r in src.copurchase_edges(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) == 3 * (40 + 1 + 2 + 1 + 40 + 80 + 40 + 2 + 1 + 2)
    dense = sorted(e for e in got if e >= 1 << 62)
    assert dense == list(range((1 << 62) + 1, (1 << 62) + 1 + 3 * (8 + 8 + 2 + 1 + 80 + 40 + 2 + 1 + 2)))
    assert {((1 * 8 + 1) * 8 + 2) * 32 + k for k in range(1, 33)} <= set(got)
