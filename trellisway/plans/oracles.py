"""The SQL that each registered query must equal, built from shared parts."""

from __future__ import annotations

from trellisway.plans.queries import CO, CO_SAMPLE, HAND, HAND_SAMPLE, SEEDS, SLICES, P

# ---------------------------------------------------------------- parts
# The draws, their ranks and the types are written out here by their definitions, not taken from the operators, so that
# a mistake in either shows.

_M = 2147483647
#: What each kind of draw adds: the fixed sample, priorities, groups, slots.
_OFFSETS = {"sample": 53037, "priority": 93729, "group": 134421, "slot": 175113}


def _draw(which: str, seed: str = "seed") -> str:
    square = lambda x, a, b: f"(({x} * {x} + {x} * {a} + {b}) % {_M})"
    first = f"((eid % {_M} * 48271 + eid % 998244353 * 16807 + {seed} * 69621 + {_OFFSETS[which]}) % {_M})"
    return f"({square(square(first, 25173, 13849), 39373, 7)} * 48271 % {_M})"


def _rho(draw: str) -> str:
    """The number of halvings of 1 that still leave what is above the draw, and one."""
    return f"(32 - ceil(log2({_M + 1} - {draw}))::INT)"


def _type(bi: str, f: str, g: str) -> str:
    """The type of an edge s->d (or both ways) with z, by the ways of z's edges as s (f) and d (g) see them: by the number
    of two-way edges; with one of them, by whether its opposite node only sends or only receives."""
    return f"""CASE {bi}::INT + ({f} = 'bi')::INT + ({g} = 'bi')::INT
    WHEN 3 THEN 6 WHEN 2 THEN 5 WHEN 0 THEN CASE WHEN {f} = 'in' AND {g} = 'out' THEN 1 ELSE 0 END
    ELSE CASE WHEN {bi} AND {f} = 'in' AND {g} = 'in' THEN 3 WHEN {bi} AND {f} = 'out' AND {g} = 'out' THEN 4
         WHEN {f} = 'bi' AND {g} = 'in' THEN 4 WHEN {g} = 'bi' AND {f} = 'out' THEN 3 ELSE 2 END END"""



#: Equal places of an order are numbered; up to 32 of them have digits of their own in an id, on lines up to 7, and the others
#: have dense numbers from 2^62 on, by order, lines and number.
_CO_RAW = """co_pairs AS (
  SELECT *, row_number() OVER (PARTITION BY ok, la, lb ORDER BY t, s, d) AS copy
  FROM (SELECT a.l_orderkey AS ok, a.l_linenumber::BIGINT AS la, b.l_linenumber::BIGINT AS lb, a.l_partkey AS s, b.l_partkey AS d,
               date_diff('day', DATE '1995-01-01', a.l_shipdate::DATE)::BIGINT AS t
        FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber)
), co_raw AS (
  SELECT ((ok * 8 + la) * 8 + lb) * 32 + copy AS eid, t, s, d FROM co_pairs WHERE copy <= 32 AND lb < 8
  UNION ALL
  SELECT 4611686018427387904 + row_number() OVER (ORDER BY ok, la, lb, copy), t, s, d FROM co_pairs WHERE copy > 32 OR lb >= 8
)"""
_HAND_RAW = """hand_raw AS (
  SELECT a.event_id AS eid, floor(epoch(a.ts))::BIGINT AS t, a.user_id AS s, b.user_id AS d, a.event_type = 'purchase' AS bi
  FROM events a JOIN events b ON b.event_id = a.event_id + 1
)"""
_CO = f"""{_CO_RAW}, e AS (
  SELECT eid, t - min(t) OVER () AS t, greatest(s, d) AS s, least(s, d) AS d FROM co_raw WHERE s <> d
)"""
_HAND = f"""{_HAND_RAW}, e AS (
  SELECT eid, t - min(t) OVER () AS t, CASE WHEN bi THEN greatest(s, d) ELSE s END AS s, CASE WHEN bi THEN least(s, d) ELSE d END AS d, bi FROM hand_raw WHERE s <> d
)"""
_HAND_PLAIN = f"""{_HAND_RAW}, e AS (
  SELECT eid, t - min(t) OVER () AS t, greatest(s, d) AS s, least(s, d) AS d FROM hand_raw WHERE s <> d
)"""


def _points(step: int) -> str:
    return f"""c AS (
  SELECT row_number() OVER (ORDER BY bucket) AS cp, bucket, first[1] AS cp_t, first[2] AS cp_eid
  FROM (SELECT t // {step} AS bucket, min([t, eid]) AS first FROM e WHERE t >= {step} GROUP BY 1)
)"""


def _window(spec, extra: str = "") -> str:
    return f"""win AS (
  SELECT c.cp, c.cp_t, e.* FROM e JOIN c ON (e.t < c.cp_t OR (e.t = c.cp_t AND e.eid <= c.cp_eid)) AND e.t >= c.cp_t - {spec.window} {extra}
)"""


_CO_WIN = f"{_CO}, {_points(CO.step)}, {_window(CO)}"
_HAND_WIN = f"{_HAND}, {_points(HAND.step)}, {_window(HAND)}"
_FREQ = "fr AS (SELECT cp, s, d, count(*) AS f FROM win GROUP BY ALL)"
_FREQ_BI = "fr AS (SELECT cp, s, d, bi, count(*) AS f FROM win GROUP BY ALL)"
_TRI = """tri AS (
  SELECT x.cp, x.s AS a, x.d AS b, y.d AS c, x.f * y.f * z.f AS w
  FROM fr x JOIN fr y ON x.cp = y.cp AND x.d = y.s JOIN fr z ON z.cp = x.cp AND z.s = x.s AND z.d = y.d
)"""
_TYPED = """one AS (SELECT cp, s AS x, d AS y, f FROM fr WHERE NOT bi), two AS (
  SELECT cp, s AS x, d AS y, f FROM fr WHERE bi UNION ALL SELECT cp, d, s, f FROM fr WHERE bi
), tri AS (
  SELECT 0 AS type, p.cp, p.x AS a, p.y AS b, q.y AS c, p.f * q.f * r.f AS w FROM one p JOIN one q ON p.cp = q.cp AND p.x = q.x JOIN one r ON r.cp = p.cp AND r.x = p.y AND r.y = q.y
  UNION ALL
  SELECT 1, p.cp, p.x, p.y, q.x, p.f * q.f * r.f FROM one p JOIN one q ON p.cp = q.cp AND p.x = q.y JOIN one r ON r.cp = p.cp AND r.x = p.y AND r.y = q.x WHERE p.y < p.x AND q.x < p.x
  UNION ALL
  SELECT 2, p.cp, p.x, p.y, q.x, p.f * q.f * r.f FROM two p JOIN one q ON p.cp = q.cp AND p.x = q.y JOIN one r ON r.cp = p.cp AND r.x = p.y AND r.y = q.x
  UNION ALL
  SELECT 3, p.cp, p.x, p.y, q.x, p.f * q.f * r.f FROM two p JOIN one q ON p.cp = q.cp AND p.x = q.y JOIN one r ON r.cp = p.cp AND r.y = p.y AND r.x = q.x WHERE p.y < p.x
  UNION ALL
  SELECT 4, p.cp, p.x, p.y, q.y, p.f * q.f * r.f FROM two p JOIN one q ON p.cp = q.cp AND p.x = q.x JOIN one r ON r.cp = p.cp AND r.x = p.y AND r.y = q.y WHERE p.y < p.x
  UNION ALL
  SELECT 5, p.cp, p.x, p.y, q.y, p.f * q.f * r.f FROM one p JOIN two q ON p.cp = q.cp AND p.x = q.x JOIN two r ON r.cp = p.cp AND r.x = p.y AND r.y = q.y
  UNION ALL
  SELECT 6, p.cp, p.x, p.y, q.y, p.f * q.f * r.f FROM two p JOIN two q ON p.cp = q.cp AND p.x = q.x JOIN two r ON r.cp = p.cp AND r.x = p.y AND r.y = q.y WHERE q.y < p.y AND p.y < p.x
)"""
_ALL_TYPES = "(SELECT cp, type::INT AS type FROM c, range(7) x(type))"
_SEEDED = "se AS (SELECT e.*, seed::INT AS seed FROM e, range({n}) x(seed))"


def _seeded(base: str, n: int = SEEDS) -> str:
    return f"{base}, {_SEEDED.format(n=n)}"


def _slots(spec) -> str:
    g = _draw("group")
    return f"""sl AS (
  SELECT *, (t - (grp - {spec.groups}) * {spec.window // spec.groups}) // {spec.window} AS slice
  FROM (SELECT *, {_draw("priority")} AS priority, ({g}) % {spec.groups} AS grp, ({_draw("slot")}) % {spec.slots} AS slot FROM se)
)"""


def _states(base: str, wspec, spec) -> str:
    """st: each occupied place at each checkpoint, with a and b as lists [priority, t, eid, s, d]; sz: its size and estimate."""
    m, alpha = spec.slots, spec.alpha
    now = f"(c.cp_t - (grp - {spec.groups}) * {spec.window // spec.groups}) // {spec.window}"
    return f"""{_seeded(base)}, {_points(wspec.step)}, {_slots(spec)}, ab AS (
  SELECT seed, cp, cp_t, grp, slot,
         max([priority, t, eid, s, d]) FILTER (slice = {now} - 1) AS a, max([priority, t, eid, s, d]) FILTER (slice = {now}) AS b
  FROM sl JOIN c ON (sl.t < c.cp_t OR (sl.t = c.cp_t AND sl.eid <= c.cp_eid)) AND sl.slice >= {now} - 1
  GROUP BY seed, cp, cp_t, grp, slot
), st AS (
  SELECT seed, cp, grp, slot, CASE WHEN a IS NULL OR b[1] >= a[1] THEN b WHEN a[2] >= cp_t - {spec.window} THEN a END AS edge, greatest(a[1], b[1]) AS top FROM ab
), gr AS (
  SELECT seed, cp, grp, count(edge) AS valid, count(*) AS occ, {m} - count(*) + sum(pow(2.0::DOUBLE, -{_rho("top")})) AS q FROM st GROUP BY ALL
), sz AS (
  SELECT seed, cp, sum(valid)::BIGINT AS n,
         sum((CASE WHEN {alpha!r}::DOUBLE * {m * m} / q < {2.5 * m} AND occ < {m} THEN -ln(1 - occ::DOUBLE / {m}) * {m} ELSE {alpha!r}::DOUBLE * {m * m} / q END) * valid / occ) AS edges
  FROM gr GROUP BY ALL
), pz AS (
  SELECT *, CASE WHEN n > 3 AND edges > 3 THEN n / edges * (n - 1) / (edges - 1) * (n - 2) / (edges - 2) END AS p FROM sz
)"""


_CO_STATES = _states(_CO, CO, CO_SAMPLE)
_CO_SAMPLE_TRI = """sf AS (SELECT seed, cp, edge[4] AS s, edge[5] AS d, count(*) AS f FROM st WHERE edge IS NOT NULL GROUP BY ALL), tri AS (
  SELECT x.seed, x.cp, x.s AS a, x.d AS b, y.d AS c, x.f * y.f * z.f AS w
  FROM sf x JOIN sf y ON x.seed = y.seed AND x.cp = y.cp AND x.d = y.s JOIN sf z ON z.seed = x.seed AND z.cp = x.cp AND z.s = x.s AND z.d = y.d
)"""
_HAND_STATES = _states(_HAND, HAND, HAND_SAMPLE).replace("[priority, t, eid, s, d]", "[priority, t, eid, s, d, bi::BIGINT]")
_HAND_SAMPLE_TRI = "fs AS (SELECT seed * 100000 + cp AS cp, edge[4] AS s, edge[5] AS d, edge[6] = 1 AS bi, count(*) AS f FROM st WHERE edge IS NOT NULL GROUP BY ALL), " + _TYPED.replace("FROM fr", "FROM fs")


def _lives(base: str, spec, extra: str = "") -> str:
    """life: when each sampled edge is valid, from records compared in their place, and first arrivals by as-of joins."""
    w = spec.window
    return f"""{_seeded(base)}, {_slots(spec)}, tm AS (
  SELECT t AS at_t, min(eid) AS at_eid FROM e GROUP BY t
), rec AS (
  SELECT *, lead([t, eid]) OVER (PARTITION BY seed, grp, slot, slice ORDER BY t, eid) AS next_record
  FROM (SELECT *, max(priority) OVER (PARTITION BY seed, grp, slot, slice ORDER BY t, eid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM sl)
  WHERE seen IS NULL OR priority >= seen
), dated AS (
  SELECT r.*, b.priority AS top_before, (r.grp - {spec.groups}) * {w // spec.groups} + {w} * (r.slice + 1) AS switch_x, r.t + {w} + 1 AS expire_x,
         (SELECT min([n.t, n.eid]) FROM rec n WHERE n.seed = r.seed AND n.grp = r.grp AND n.slot = r.slot AND n.slice = r.slice + 1 AND n.priority >= r.priority) AS beaten
  FROM rec r LEFT JOIN rec b ON b.seed = r.seed AND b.grp = r.grp AND b.slot = r.slot AND b.slice = r.slice - 1 AND b.next_record IS NULL
), found AS (
  SELECT d.*, CASE WHEN x.at_t IS NOT NULL THEN [x.at_t, x.at_eid] END AS switch, CASE WHEN y.at_t IS NOT NULL THEN [y.at_t, y.at_eid] END AS expiry
  FROM dated d ASOF LEFT JOIN tm x ON d.switch_x <= x.at_t ASOF LEFT JOIN tm y ON d.expire_x <= y.at_t
), life AS (
  SELECT seed, grp, slot, priority, t, eid, s, d{extra}, begun, ended, coalesce(expiry <= ended, false) AS expired
  FROM (SELECT *, CASE WHEN top_before IS NULL OR priority >= top_before THEN [t, eid] WHEN next_record IS NULL AND t >= switch[1] - {w} THEN switch END AS begun,
               list_min(list_filter([next_record, beaten, expiry], lambda x: x IS NOT NULL)) AS ended FROM found)
  WHERE begun IS NOT NULL AND (ended IS NULL OR ended > begun)
)"""


_ENDS = """en AS (
  SELECT seed, s AS node, d AS other, t, eid, begun, ended, expired FROM life UNION ALL SELECT seed, d, s, t, eid, begun, ended, expired FROM life
)"""
_ARRIVAL = f"""{_ENDS}, arr AS (
  SELECT a.seed, a.t, a.eid, least(a.t, f.t, g.t) AS oldest
  FROM se a JOIN en f ON f.seed = a.seed AND f.node = a.s AND f.begun <= [a.t, a.eid] AND (f.ended IS NULL OR f.ended > [a.t, a.eid])
            JOIN en g ON g.seed = a.seed AND g.node = a.d AND g.other = f.other AND g.begun <= [a.t, a.eid] AND (g.ended IS NULL OR g.ended > [a.t, a.eid])
)"""
_STILL = "{f}.begun < x.ended AND ({f}.ended IS NULL OR {f}.ended > x.ended OR ({f}.ended = x.ended AND (NOT {f}.expired OR [{f}.t, {f}.eid] > [x.t, x.eid])))"
_GONE = f"""gone AS (
  SELECT x.seed, x.t, x.eid, x.ended FROM life x JOIN en f ON f.seed = x.seed AND f.node = x.s AND {_STILL.format(f="f")}
         JOIN en g ON g.seed = x.seed AND g.node = x.d AND g.other = f.other AND {_STILL.format(f="g")}
  WHERE x.expired
)"""

_FIXED = f"""kept AS (SELECT * FROM se WHERE {_draw("sample")} < {int(P * _M)}), kw AS (
  SELECT seed, cp, s, d, count(*) AS f FROM kept JOIN c ON (t < cp_t OR (t = cp_t AND eid <= cp_eid)) AND t >= cp_t - {CO.window} GROUP BY ALL
), kt AS (
  SELECT x.seed, x.cp, sum(x.f * y.f * z.f) AS w FROM kw x JOIN kw y ON x.seed = y.seed AND x.cp = y.cp AND x.d = y.s JOIN kw z ON z.seed = x.seed AND z.cp = x.cp AND z.s = x.s AND z.d = y.d GROUP BY ALL
)"""


def _fixed(n: int) -> str:
    return f"{_seeded(_CO, n)}, {_points(CO.step)}, {_FIXED}, est AS (SELECT seed, cp, coalesce(w, 0)::DOUBLE / {P**3} AS estimate FROM c CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN kt USING (seed, cp))"


_ERRORS = f"""WITH {_fixed(3)}, {_window(CO)}, {_FREQ}, {_TRI}, gold AS (
  SELECT cp, sum(w)::DOUBLE AS g FROM tri GROUP BY cp
), err AS (
  SELECT seed, cp, CASE WHEN coalesce(g, 0) <> 0 THEN abs(estimate - g) / g END AS error FROM est LEFT JOIN gold USING (cp) WHERE cp > 10
)"""
_RUNS = "runs AS (SELECT seed, avg(error) AS avg_error, max(error) AS max_error, count(*) FILTER (error IS NULL) AS undefined FROM err GROUP BY seed)"

_SL = HAND.window // SLICES


def _fixed_sliced() -> str:
    w, now = HAND.window, f"greatest(ceil(cp_t / {_SL}.0)::BIGINT - 1, 0)"
    return f"""WITH {_seeded(_HAND_PLAIN)}, {_points(HAND.step)}, tm AS (SELECT t AS at_t, min(eid) AS at_eid FROM e GROUP BY t), life AS (
  SELECT k.*, [k.t, k.eid] AS begun, CASE WHEN at_t IS NOT NULL THEN [at_t, at_eid] END AS ended, at_t IS NOT NULL AS expired
  FROM (SELECT *, t + {w + 1} AS x FROM se WHERE {_draw("sample")} < {int(P * _M)}) k ASOF LEFT JOIN tm ON k.x <= tm.at_t
), {_ENDS}, arr AS (
  SELECT a.seed, [a.t, a.eid] AS happened, ceil(least(f.t, g.t) / {_SL}.0)::BIGINT - 1 AS slice
  FROM se a JOIN en f ON f.seed = a.seed AND f.node = a.s AND f.begun < [a.t, a.eid] AND (f.ended IS NULL OR f.ended > [a.t, a.eid])
            JOIN en g ON g.seed = a.seed AND g.node = a.d AND g.other = f.other AND g.begun < [a.t, a.eid] AND (g.ended IS NULL OR g.ended > [a.t, a.eid])
), {_GONE}, runs AS (SELECT seed, cp, cp_t, cp_eid, {now} AS now FROM c CROSS JOIN (SELECT DISTINCT seed FROM se)), plus AS (
  SELECT r.seed, cp, count(*) AS n FROM runs r JOIN arr ON arr.seed = r.seed AND happened <= [cp_t, cp_eid] AND slice BETWEEN now - {SLICES} AND now GROUP BY ALL
), minus AS (
  SELECT r.seed, cp, count(*) AS n FROM runs r JOIN gone ON gone.seed = r.seed AND ended <= [cp_t, cp_eid] AND greatest(ceil(ended[1] / {_SL}.0)::BIGINT - 1, 0) = now GROUP BY ALL
)
SELECT seed, cp, round(greatest(coalesce(plus.n, 0) / {P**2} - coalesce(minus.n, 0) / {P**3}, 0), 6) AS estimate FROM runs LEFT JOIN plus USING (seed, cp) LEFT JOIN minus USING (seed, cp)"""


def _chances(asked: str, name: str, spec) -> str:
    """n and the estimate by definition at each asked moment (seed, t, eid, life: SQL for what counts as valid then)."""
    m, alpha, w = spec.slots, spec.alpha, spec.window
    return f"""{name}_ab AS (
  SELECT q.seed, q.t, q.eid, q.x_t, q.x_eid, sl.grp, sl.slot,
         max(sl.priority) FILTER (sl.slice = (q.now - (grp - {spec.groups}) * {w // spec.groups}) // {w} - 1) AS a, max(sl.priority) FILTER (sl.slice = (q.now - (grp - {spec.groups}) * {w // spec.groups}) // {w}) AS b
  FROM {asked} q JOIN sl ON sl.seed = q.seed AND sl.t >= q.now - {2 * w} AND [sl.t, sl.eid] <= q.upto AND sl.slice >= (q.now - (grp - {spec.groups}) * {w // spec.groups}) // {w} - 1
  GROUP BY ALL
), {name}_occ AS (
  SELECT seed, t, eid, x_t, x_eid, grp, count(*) AS occ, {m} - count(*) + sum(pow(2.0::DOUBLE, -{_rho("greatest(a, b)")})) AS q FROM {name}_ab WHERE a IS NOT NULL OR b IS NOT NULL GROUP BY ALL
), {name}_valid AS (
  SELECT q.seed, q.t, q.eid, q.x_t, q.x_eid, l.grp, count(*) AS valid FROM {asked} q JOIN life l ON l.seed = q.seed AND l.t >= q.now - {2 * w} AND {{still}} GROUP BY ALL
), {name} AS (
  SELECT seed, t, eid, x_t, x_eid, coalesce(n, 0)::BIGINT AS n, coalesce(edges, 0) AS edges,
         CASE WHEN n > 1 AND edges > 1 THEN n / edges * (n - 1) / (edges - 1) END AS inc,
         CASE WHEN n > 2 AND edges > 2 THEN n / edges * (n - 1) / (edges - 1) * (n - 2) / (edges - 2) END AS exp
  FROM {asked} LEFT JOIN (
    SELECT seed, t, eid, x_t, x_eid, sum(coalesce(valid, 0)) AS n,
           sum((CASE WHEN {alpha!r}::DOUBLE * {m * m} / q < {2.5 * m} AND occ < {m} THEN -ln(1 - occ::DOUBLE / {m}) * {m} ELSE {alpha!r}::DOUBLE * {m * m} / q END) * coalesce(valid, 0) / occ) AS edges
    FROM {name}_occ LEFT JOIN {name}_valid USING (seed, t, eid, x_t, x_eid, grp) GROUP BY ALL
  ) USING (seed, t, eid, x_t, x_eid)
)"""


_MOMENTS = "am AS (SELECT seed, t, eid, -1 AS x_t, -1 AS x_eid, t AS now, [t, eid] AS upto FROM se)"
_CHANCES = f"""WITH {_lives(_HAND_PLAIN, HAND_SAMPLE)}, {_MOMENTS}, {_chances("am", "chance", HAND_SAMPLE).format(still="l.begun <= q.upto AND (l.ended IS NULL OR l.ended > q.upto)")}"""


_BEFORE = "before AS (SELECT [t, eid] AS arrival, lag([t, eid]) OVER (ORDER BY t, eid) AS previous FROM e), xm AS (SELECT seed, t, eid, x_t, x_eid, previous[1] AS now, previous AS upto FROM moved JOIN before ON arrival = [t, eid])"
_FATE = _chances("xm", "fate", HAND_SAMPLE).format(still="l.begun <= q.upto AND (l.ended IS NULL OR l.ended > [q.t, q.eid] OR (l.ended = [q.t, q.eid] AND (NOT l.expired OR [l.t, l.eid] > [q.x_t, q.x_eid])))")


def _ten_runs(estimates: str) -> str:
    """The errors of estimates (seed, cp, estimate) against the exact count, over ten seeds."""
    return f"""WITH est AS (SELECT * FROM ({estimates.replace(f"range({SEEDS}) x(seed)", "range(10) x(seed)")})), gold AS (
  SELECT cp, g FROM (WITH {_HAND_PLAIN}, {_points(HAND.step)}, {_window(HAND)}, {_FREQ}, {_TRI} SELECT cp, sum(w)::DOUBLE AS g FROM tri GROUP BY cp)
), err AS (
  SELECT seed, cp, CASE WHEN coalesce(g, 0) <> 0 THEN abs(estimate - g) / g END AS error FROM est LEFT JOIN gold USING (cp) WHERE cp > 10
), {_RUNS} SELECT round(avg(avg_error), 6) AS avg_error, round(avg(max_error), 6) AS max_error, count(*) AS runs FROM runs"""


def _kept_late(wait: int) -> str:
    """e: the edges that are not too late."""
    return f"""{_HAND_PLAIN.replace("e AS (", "every AS (")}, filed AS (
  SELECT *, (t // 86400 + CASE WHEN eid % 11 = 0 THEN 4 WHEN eid % 7 = 0 THEN 1 ELSE 0 END) // 5 AS file FROM every
), marks AS (
  SELECT file, max(max(t)) OVER (ORDER BY file ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark FROM filed GROUP BY file
), e AS (
  SELECT eid, t, s, d FROM filed JOIN marks USING (file) WHERE mark IS NULL OR t >= mark - {wait}
)"""


def _late(wait: int) -> str:
    """Counts of these edges at the checkpoints that are over when the stream ends."""
    return f"""WITH {_kept_late(wait)}, {_points(HAND.step)}, {_window(HAND)}, {_FREQ}, {_TRI}
SELECT bucket, cp_t, coalesce(n, 0)::BIGINT AS triangles FROM c LEFT JOIN (SELECT cp, sum(w) AS n FROM tri GROUP BY cp) USING (cp) WHERE cp_t < (SELECT max(t) FROM e) - {wait}"""


_HAND_PLAIN_STATES = _states(_HAND_PLAIN, HAND, HAND_SAMPLE)
_HAND_SWTC = f"""WITH {_HAND_PLAIN_STATES}, {_CO_SAMPLE_TRI} SELECT seed, cp, bucket, coalesce(w / p, 0) AS estimate
FROM c CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN pz USING (seed, cp) LEFT JOIN (SELECT seed, cp, sum(w)::DOUBLE AS w FROM tri GROUP BY ALL) USING (seed, cp)"""

_LATE_SWTC = f"""WITH {_states(_kept_late(2 * 86400), HAND, HAND_SAMPLE)}, {_CO_SAMPLE_TRI} SELECT seed, bucket, coalesce(w / p, 0) AS estimate
FROM (SELECT * FROM c WHERE cp_t < (SELECT max(t) FROM e) - {2 * 86400}) CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN pz USING (seed, cp) LEFT JOIN (SELECT seed, cp, sum(w)::DOUBLE AS w FROM tri GROUP BY ALL) USING (seed, cp)"""


def _cbs(correct: bool) -> str:
    """Arrivals by definition; the uncorrected sum needs no chances of expiries. Those are taken before the arrival's own
    slices and insertion, so the state is that of the arrival before it."""
    lost = f"""moved AS (
  SELECT DISTINCT g.seed, g.ended[1] AS t, g.ended[2] AS eid, g.t AS x_t, g.eid AS x_eid FROM gone g
), before AS (
  SELECT [t, eid] AS arrival, lag([t, eid]) OVER (ORDER BY t, eid) AS previous FROM e
), xm AS (
  SELECT seed, t, eid, x_t, x_eid, previous[1] AS now, previous AS upto FROM moved JOIN before ON arrival = [t, eid]
), {_chances("xm", "fate", HAND_SAMPLE).format(still="l.begun <= q.upto AND (l.ended IS NULL OR l.ended > [q.t, q.eid] OR (l.ended = [q.t, q.eid] AND (NOT l.expired OR [l.t, l.eid] > [q.x_t, q.x_eid])))")}, minus AS (
  SELECT r.seed, cp, sum(coalesce(1 / exp, 0)) AS n
  FROM runs r JOIN gone g ON g.seed = r.seed AND g.ended <= [cp_t, cp_eid] AND greatest(ceil(g.ended[1] / {_SL}.0)::BIGINT - 1, 0) = now AND g.t > now * {_SL} - {HAND.window}
       JOIN fate f ON f.seed = g.seed AND f.t = g.ended[1] AND f.eid = g.ended[2] AND f.x_t = g.t AND f.x_eid = g.eid GROUP BY ALL
)"""
    parts = f"""{_CHANCES}, {_ARRIVAL}, {_GONE}, runs AS (
  SELECT seed, cp, cp_t, cp_eid, greatest(ceil(cp_t / {_SL}.0)::BIGINT - 1, 0) AS now FROM c CROSS JOIN (SELECT DISTINCT seed FROM se)
), plus AS (
  SELECT r.seed, cp, sum(coalesce(1 / inc, 0)) AS n FROM runs r JOIN arr a ON a.seed = r.seed AND [a.t, a.eid] <= [cp_t, cp_eid] AND ceil(oldest / {_SL}.0)::BIGINT - 1 BETWEEN now - {SLICES} AND now
       JOIN chance k ON k.seed = a.seed AND k.t = a.t AND k.eid = a.eid GROUP BY ALL
)""".replace("WITH ", f"WITH {_HAND_PLAIN}, {_points(HAND.step)}, ", 1).replace(f"{_HAND_PLAIN}, {_points(HAND.step)}, {_HAND_PLAIN}", f"{_HAND_PLAIN}, {_points(HAND.step)}")
    if not correct:
        return f"{parts} SELECT seed, cp, round(coalesce(plus.n, 0), 6) AS estimate FROM runs LEFT JOIN plus USING (seed, cp)"
    return f"{parts}, {lost} SELECT seed, cp, round(coalesce(plus.n, 0) - coalesce(minus.n, 0), 6) AS estimate FROM runs LEFT JOIN plus USING (seed, cp) LEFT JOIN minus USING (seed, cp)"


def _cbs_typed() -> str:
    """As _cbs, with the neighbours' directions and the type that they close."""
    still = _STILL.format(f="f"), _STILL.format(f="g")
    return f"""WITH {_lives(_HAND, HAND_SAMPLE, ", bi")}, {_points(HAND.step)}, {_MOMENTS},
{_chances("am", "chance", HAND_SAMPLE).format(still="l.begun <= q.upto AND (l.ended IS NULL OR l.ended > q.upto)")}, en AS (
  SELECT seed, s AS node, d AS other, CASE WHEN bi THEN 'bi' ELSE 'out' END AS dir, t, eid, begun, ended, expired FROM life
  UNION ALL SELECT seed, d, s, CASE WHEN bi THEN 'bi' ELSE 'in' END, t, eid, begun, ended, expired FROM life
), arr AS (
  SELECT a.seed, a.t, a.eid, {_type("a.bi", "f.dir", "g.dir")} AS type, least(a.t, f.t, g.t) AS oldest
  FROM se a JOIN en f ON f.seed = a.seed AND f.node = a.s AND f.begun <= [a.t, a.eid] AND (f.ended IS NULL OR f.ended > [a.t, a.eid])
            JOIN en g ON g.seed = a.seed AND g.node = a.d AND g.other = f.other AND g.begun <= [a.t, a.eid] AND (g.ended IS NULL OR g.ended > [a.t, a.eid])
), gone AS (
  SELECT x.seed, x.t, x.eid, x.ended, {_type("x.bi", "f.dir", "g.dir")} AS type FROM life x JOIN en f ON f.seed = x.seed AND f.node = x.s AND {still[0]}
         JOIN en g ON g.seed = x.seed AND g.node = x.d AND g.other = f.other AND {still[1]}
  WHERE x.expired
), runs AS (
  SELECT seed, cp, cp_t, cp_eid, greatest(ceil(cp_t / {_SL}.0)::BIGINT - 1, 0) AS now FROM c CROSS JOIN (SELECT DISTINCT seed FROM se)
), plus AS (
  SELECT r.seed, cp, type, sum(coalesce(1 / inc, 0)) AS n FROM runs r JOIN arr a ON a.seed = r.seed AND [a.t, a.eid] <= [cp_t, cp_eid] AND ceil(oldest / {_SL}.0)::BIGINT - 1 BETWEEN now - {SLICES} AND now
       JOIN chance k ON k.seed = a.seed AND k.t = a.t AND k.eid = a.eid GROUP BY ALL
), moved AS (
  SELECT DISTINCT g.seed, g.ended[1] AS t, g.ended[2] AS eid, g.t AS x_t, g.eid AS x_eid FROM gone g
), before AS (
  SELECT [t, eid] AS arrival, lag([t, eid]) OVER (ORDER BY t, eid) AS previous FROM e
), xm AS (
  SELECT seed, t, eid, x_t, x_eid, previous[1] AS now, previous AS upto FROM moved JOIN before ON arrival = [t, eid]
), {_chances("xm", "fate", HAND_SAMPLE).format(still="l.begun <= q.upto AND (l.ended IS NULL OR l.ended > [q.t, q.eid] OR (l.ended = [q.t, q.eid] AND (NOT l.expired OR [l.t, l.eid] > [q.x_t, q.x_eid])))")}, minus AS (
  SELECT r.seed, cp, type, sum(coalesce(1 / exp, 0)) AS n
  FROM runs r JOIN gone g ON g.seed = r.seed AND g.ended <= [cp_t, cp_eid] AND greatest(ceil(g.ended[1] / {_SL}.0)::BIGINT - 1, 0) = now AND g.t > now * {_SL} - {HAND.window}
       JOIN fate f ON f.seed = g.seed AND f.t = g.ended[1] AND f.eid = g.ended[2] AND f.x_t = g.t AND f.x_eid = g.eid GROUP BY ALL
)
SELECT seed, cp, type::INT AS type, round(coalesce(plus.n, 0) - coalesce(minus.n, 0), 6) AS estimate
FROM runs CROSS JOIN range(7) x(type) LEFT JOIN plus USING (seed, cp, type) LEFT JOIN minus USING (seed, cp, type)"""


#: fr: how often each pair is in the window of the last edge at or before each asked time.
_MOMENTS_AT = f"""{_HAND_PLAIN}, asks AS (
  SELECT DISTINCT CASE WHEN eid % 200 = 0 THEN -eid ELSE t + eid * 12345 END AS asked FROM e WHERE eid % 50 = 0
), c AS (
  SELECT asked, asked AS cp, max(e.t) AS now FROM asks LEFT JOIN e ON e.t <= asked GROUP BY asked
), fr AS (
  SELECT cp, s, d, count(*) AS f FROM c JOIN e ON e.t <= now AND e.t >= now - {HAND.window} GROUP BY ALL
)"""

ORACLES: dict[str, str] = {
    "read_edges": f"WITH {_CO_RAW} SELECT s, d, t, count(*) AS n FROM co_raw GROUP BY ALL",
    "read_edges_directed": f"WITH {_HAND_RAW} SELECT s, d, t, bi, count(*) AS n FROM hand_raw GROUP BY ALL",
    "read_edges_arrival": f"WITH {_CO_RAW} SELECT row_number() OVER (ORDER BY t, eid) - 1 AS eid, t, s, d FROM co_raw",
    "triangle_count_from_text": f"WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT cp, coalesce(sum(w), 0)::BIGINT AS triangles FROM (SELECT cp FROM c) LEFT JOIN tri USING (cp) GROUP BY cp",
    "count_series": f"""SELECT * FROM (WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT 'golden' AS method, -1 AS type, 0 AS seed, cp, coalesce(sum(w), 0)::DOUBLE AS count FROM c LEFT JOIN tri USING (cp) GROUP BY cp)
UNION ALL SELECT * FROM (WITH {_HAND_WIN}, {_FREQ_BI}, {_TYPED} SELECT 'golden_directed', 1, 0, cp, count(w)::DOUBLE FROM c LEFT JOIN (SELECT * FROM (SELECT cp, type, a, b, c, w FROM tri) WHERE type = 1) USING (cp) GROUP BY cp)""",
    "adjacency_lists": f"""WITH {_HAND}, adj AS (SELECT s AS node, CASE WHEN bi THEN 'bi' ELSE 'out' END AS dir, d AS nbr FROM e UNION SELECT d, CASE WHEN bi THEN 'bi' ELSE 'in' END, s FROM e)
SELECT node, dir, string_agg(nbr::VARCHAR, ',' ORDER BY nbr) AS nbrs FROM adj GROUP BY ALL""",
    "drop_self_loops": f"WITH {_CO_RAW} SELECT eid, t, s, d FROM co_raw WHERE s <> d",
    "rebase_time": f"WITH {_CO_RAW} SELECT eid, t - min(t) OVER () AS t, s, d FROM co_raw WHERE s <> d",
    "canonicalize": f"WITH {_CO} SELECT eid, t, s, d FROM e",
    "canonicalize_directed": f"WITH {_HAND} SELECT eid, t, s, d, bi FROM e",
    "with_arrival": f"WITH {_CO} SELECT eid, s, d, t AS arrival_t, eid AS arrival_eid FROM e",
    "window_spec": f"""WITH {_CO}, u AS (SELECT (max(t) - min(t))::DOUBLE / count(*) AS unit, count(*) AS edges FROM e)
SELECT trunc(10000 * unit)::BIGINT AS "window", trunc(10000 * unit)::BIGINT // 10 AS step, edges FROM u""",
    "sample_spec": f"""WITH {_CO}, u AS (SELECT (max(t) - min(t))::DOUBLE / count(*) AS unit, count(*) AS edges FROM e)
SELECT trunc(10000 * unit)::BIGINT AS "window", 10::BIGINT AS groups, 40::BIGINT AS slots, edges FROM u""",
    "checkpoints": f"WITH {_CO}, {_points(CO.step)} SELECT * FROM c",
    "directed_adjacency": f"""WITH {_HAND} SELECT eid, s AS node, d AS nbr, CASE WHEN bi THEN 'bi' ELSE 'out' END AS dir FROM e UNION ALL SELECT eid, d, s, CASE WHEN bi THEN 'bi' ELSE 'in' END FROM e""",
    "window_edges": f"WITH {_CO_WIN} SELECT cp, eid, t, s, d FROM win",
    "edge_frequencies": f"WITH {_CO_WIN}, {_FREQ} SELECT * FROM fr",
    "edge_frequencies_directed": f"WITH {_HAND_WIN}, {_FREQ_BI} SELECT * FROM fr",
    "distinct_edge_count": f"WITH {_CO_WIN} SELECT cp, count(DISTINCT [s, d]) AS distinct_edges FROM win GROUP BY cp",
    "distinct_edge_count_directed": f"WITH {_HAND_WIN} SELECT cp, count(DISTINCT [s, d, bi::BIGINT]) AS distinct_edges FROM win GROUP BY cp",
    "edge_instance_count": f"WITH {_CO_WIN} SELECT cp, count(*) AS instances FROM win GROUP BY cp",
    "node_count_directed": f"WITH {_HAND_WIN} SELECT cp, count(DISTINCT node) AS nodes FROM (SELECT cp, unnest([s, d]) AS node FROM win) GROUP BY cp",
    "node_count": f"WITH {_CO_WIN} SELECT cp, count(DISTINCT node) AS nodes FROM (SELECT cp, unnest([s, d]) AS node FROM win) GROUP BY cp",
    "window_deltas": f"WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT cp, coalesce(sum(w), 0)::BIGINT AS triangles FROM c LEFT JOIN tri USING (cp) GROUP BY cp",
    "triangle_count": f"WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT cp, count(w) AS triangles FROM (SELECT cp FROM c) LEFT JOIN tri USING (cp) GROUP BY cp",
    "triangle_count_weighted": f"WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT cp, coalesce(sum(w), 0)::BIGINT AS triangles FROM (SELECT cp FROM c) LEFT JOIN tri USING (cp) GROUP BY cp",
    **{
        name: f"""WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT cp, node, sum(w)::BIGINT AS triangles
FROM (SELECT cp, unnest([a, b, c]) AS node, {w} AS w FROM tri UNION ALL SELECT cp, unnest([s, d]), 0 FROM fr) GROUP BY ALL"""
        for name, w in (("local_triangle_count", "1"), ("local_triangle_count_weighted", "w"))
    },
    "edge_triangle_count": f"""WITH {_CO_WIN}, {_FREQ}, {_TRI} SELECT cp, p[1] AS s, p[2] AS d, sum(w)::BIGINT AS triangles
FROM (SELECT cp, unnest([[a, b], [a, c], [b, c]]) AS p, 1 AS w FROM tri UNION ALL SELECT cp, [s, d], 0 FROM fr) GROUP BY ALL""",
    "wedge_count": f"WITH {_CO_WIN}, {_FREQ} SELECT cp, sum(n * (n - 1) // 2)::BIGINT AS wedges FROM (SELECT cp, node, count(*) AS n FROM (SELECT cp, unnest([s, d]) AS node FROM fr) GROUP BY ALL) GROUP BY cp",
    "counts_at_moments": f"""WITH {_MOMENTS_AT}, {_TRI}
SELECT asked, any_value(now) AS t, coalesce(any_value(instances), 0)::BIGINT AS instances, coalesce(any_value(pairs), 0)::BIGINT AS distinct_edges, coalesce(sum(w), 0)::BIGINT AS triangles
FROM c LEFT JOIN (SELECT cp, sum(f) AS instances, count(*) AS pairs FROM fr GROUP BY cp) USING (cp) LEFT JOIN (SELECT cp, sum(w) AS w FROM tri GROUP BY cp) USING (cp) GROUP BY asked""",
    "pairs_at_moments": f"WITH {_MOMENTS_AT} SELECT cp AS asked, s, d, f FROM fr",
    "common_neighbors": f"""WITH {_CO_WIN}, {_FREQ}, nb AS (SELECT cp, s AS node, d AS z, f FROM fr UNION ALL SELECT cp, d, s, f FROM fr)
SELECT q.cp, q.s AS x, q.d AS y, count(b.z) AS common, coalesce(sum(a.f * b.f), 0)::BIGINT AS weighted, coalesce(string_agg(b.z::VARCHAR, ',' ORDER BY b.z), '') AS nodes
FROM fr q LEFT JOIN (nb a JOIN nb b ON a.cp = b.cp AND a.z = b.z) ON a.cp = q.cp AND a.node = q.s AND b.node = q.d GROUP BY ALL""",
    "directed_triangle_count": f"WITH {_HAND_WIN}, {_FREQ_BI}, {_TYPED} SELECT cp, type, count(w) AS triangles FROM {_ALL_TYPES} LEFT JOIN tri USING (cp, type) GROUP BY ALL",
    "directed_triangle_count_weighted": f"WITH {_HAND_WIN}, {_FREQ_BI}, {_TYPED} SELECT cp, type, coalesce(sum(w), 0)::BIGINT AS triangles FROM {_ALL_TYPES} LEFT JOIN tri USING (cp, type) GROUP BY ALL",
    **{
        name: f"""WITH {_HAND_WIN}, {_FREQ_BI}, {_TYPED} SELECT cp, type, node, sum(w)::BIGINT AS triangles
FROM (SELECT cp, type::INT AS type, unnest([a, b, c]) AS node, {w} AS w FROM tri UNION ALL SELECT cp, type::INT, unnest([s, d]), 0 FROM fr, range(7) x(type)) {where} GROUP BY ALL"""
        for name, w, where in (("directed_local_count", "1", ""), ("directed_local_count_weighted", "w", ""), ("local_count_a", "1", "WHERE type = 0"), ("local_count_a_weighted", "w", "WHERE type = 0"), ("local_count_b", "1", "WHERE type = 1"), ("local_count_b_weighted", "w", "WHERE type = 1"))
    },
    "triangle_census": f"WITH {_HAND_WIN}, {_FREQ_BI}, {_TYPED} SELECT cp, type, count(w) AS triangles, coalesce(sum(w), 0)::BIGINT AS weighted FROM {_ALL_TYPES} LEFT JOIN tri USING (cp, type) GROUP BY ALL",
    "bernoulli_edges": f"WITH {_seeded(_CO)} SELECT seed, eid, t, s, d FROM se WHERE {_draw('sample')} < {int(P * _M)}",
    "fixed_p_estimate": f"WITH {_fixed(SEEDS)} SELECT seed, cp, round(estimate, 6) AS estimate FROM est",
    "fixed_p_sliced_estimate": _fixed_sliced(),
    "assign_slots": f"WITH {_seeded(_CO)}, {_slots(CO_SAMPLE)} SELECT seed, eid, priority, grp, slot, slice FROM sl",
    "priority_sample_at": f"WITH {_CO_STATES} SELECT seed, cp, grp, slot, edge[1] AS priority, edge[2] AS t, edge[3] AS eid, edge[4] AS s, edge[5] AS d FROM st WHERE edge IS NOT NULL",
    "sample_size": f"WITH {_CO_STATES} SELECT seed, cp, n FROM sz",
    "edge_cardinality_estimate": f"WITH {_CO_STATES} SELECT seed, cp, n, round(edges, 6) AS edges FROM sz",
    "triple_probability": f"WITH {_CO_STATES} SELECT seed, cp, n, round(edges, 6) AS edges, round(p, 6) AS p FROM pz",
    "swtc_estimate": f"""WITH {_CO_STATES}, {_CO_SAMPLE_TRI} SELECT seed, cp, round(coalesce(w / p, 0), 6) AS estimate
FROM c CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN pz USING (seed, cp) LEFT JOIN (SELECT seed, cp, sum(w)::DOUBLE AS w FROM tri GROUP BY ALL) USING (seed, cp)""",
    "swtc_directed_estimate": f"""WITH {_HAND_STATES}, {_HAND_SAMPLE_TRI} SELECT seed, cp, type, round(coalesce(w / p, 0), 6) AS estimate
FROM {_ALL_TYPES} CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN pz USING (seed, cp)
LEFT JOIN (SELECT (cp // 100000)::INT AS seed, cp % 100000 AS cp, type, sum(w)::DOUBLE AS w FROM tri GROUP BY ALL) USING (seed, cp, type)""",
    "swtc_local_estimate": f"""WITH {_CO_STATES}, {_CO_SAMPLE_TRI} SELECT seed, cp, node, round(coalesce(sum(w)::DOUBLE / any_value(p), 0), 6) AS estimate
FROM (SELECT seed, cp, unnest([a, b, c]) AS node, w FROM tri UNION ALL SELECT seed, cp, unnest([s, d]), 0 FROM sf) LEFT JOIN pz USING (seed, cp) GROUP BY seed, cp, node""",
    "swtc_local_estimate_node": f"""WITH {_CO_STATES}, {_CO_SAMPLE_TRI} SELECT seed, cp, 1::BIGINT AS node, round(coalesce(w / p, 0), 6) AS estimate
FROM c CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN pz USING (seed, cp) LEFT JOIN (SELECT seed, cp, sum(w)::DOUBLE AS w FROM tri WHERE a = 1 OR b = 1 OR c = 1 GROUP BY ALL) USING (seed, cp)""",
    "slice_index": f"WITH {_CO} SELECT eid, ceil(t / {CO.window // SLICES}.0)::BIGINT - 1 AS slice FROM e",
    "sample_lifetimes": f"""WITH {_lives(_HAND_PLAIN, HAND_SAMPLE)} SELECT seed, grp, slot, priority, t, eid, begun[1] AS start_t, begun[2] AS start_eid, ended[1] AS end_t, ended[2] AS end_eid, expired FROM life""",
    "stream_sample_lifetimes": f"""WITH {_lives(_HAND_PLAIN, HAND_SAMPLE)} SELECT seed, grp, slot, priority, t, eid, begun[1] AS start_t, begun[2] AS start_eid, ended[1] AS end_t, ended[2] AS end_eid, expired FROM life""",
    "arrival_triangles": f"WITH {_lives(_HAND_PLAIN, HAND_SAMPLE)}, {_ARRIVAL} SELECT seed, t, eid, oldest, count(*) AS triangles FROM arr GROUP BY ALL",
    "expired_triangles": f"WITH {_lives(_HAND_PLAIN, HAND_SAMPLE)}, {_ENDS}, {_GONE} SELECT seed, t, eid, ended[1] AS at_t, ended[2] AS at_eid, count(*) AS triangles FROM gone GROUP BY ALL",
    "pair_probability": f"{_CHANCES} SELECT seed, t, eid, n, round(edges, 6) AS edges, round(inc, 6) AS inc FROM chance",
    "expiry_probability": f"""{_CHANCES}, moved AS (SELECT seed, ended[1] AS t, ended[2] AS eid, t AS x_t, eid AS x_eid FROM life WHERE expired), {_BEFORE}, {_FATE}
SELECT seed, t AS at_t, eid AS at_eid, x_t AS t, x_eid AS eid, n, round(edges, 6) AS edges, round(exp, 6) AS exp FROM fate""",
    "cbs_estimate": _cbs(True),
    "cbs_estimate_uncorrected": _cbs(False),
    "cbs_directed_estimate": _cbs_typed(),
    "replicate": f"WITH {_seeded(_CO, 10)} SELECT seed, count(*) AS edges, sum(t)::BIGINT AS times, sum(eid % 65536)::BIGINT AS ids FROM se GROUP BY seed",
    "relative_error": f"{_ERRORS} SELECT seed, cp, round(error, 6) AS error FROM err",
    "error_by_run": f"{_ERRORS}, {_RUNS} SELECT seed, round(avg_error, 6) AS avg_error, round(max_error, 6) AS max_error, undefined FROM runs",
    "error_summary": f"{_ERRORS}, {_RUNS} SELECT round(avg(avg_error), 6) AS avg_error, round(avg(max_error), 6) AS max_error, count(*) AS runs FROM runs",
    "error_summary_by_type": f"""WITH {_HAND_STATES}, {_HAND_SAMPLE_TRI}, est AS (
  SELECT seed, cp, type, coalesce(w / p, 0) AS estimate FROM {_ALL_TYPES} CROSS JOIN (SELECT DISTINCT seed FROM se) LEFT JOIN pz USING (seed, cp)
  LEFT JOIN (SELECT (cp // 100000)::INT AS seed, cp % 100000 AS cp, type, sum(w)::DOUBLE AS w FROM tri GROUP BY ALL) USING (seed, cp, type)
), gold AS (
  SELECT cp, type, sum(w)::DOUBLE AS g FROM ({f"WITH {_window(HAND)}, {_FREQ_BI}, {_TYPED} SELECT cp, type, w FROM tri"}) GROUP BY ALL
), runs AS (
  SELECT type, seed, avg(error) AS avg_error, max(error) AS max_error
  FROM (SELECT seed, cp, type, CASE WHEN g <> 0 THEN abs(estimate - g) / g END AS error FROM est LEFT JOIN gold USING (cp, type)) GROUP BY ALL
)
SELECT type, round(avg(avg_error), 6) AS avg_error, round(avg(max_error), 6) AS max_error, count(*) AS runs FROM runs GROUP BY type""",
    "error_summary_swtc": _ten_runs(_HAND_SWTC),
    "error_summary_cbs": _ten_runs(_cbs(True)),
    "stream_exact_counts": f"""WITH {_HAND_PLAIN}, {_points(HAND.step)}, {_window(HAND)}, {_FREQ}, {_TRI}
SELECT bucket, cp_t, coalesce(n, 0)::BIGINT AS triangles FROM c LEFT JOIN (SELECT cp, sum(w) AS n FROM tri GROUP BY cp) USING (cp)""",
    "stream_late_counts": _late(2 * 86400),
    "stream_cbs_estimate": _cbs(True).replace("SELECT seed, cp, round(", "SELECT seed, bucket, round(").replace("SELECT seed, cp, cp_t, cp_eid, greatest", "SELECT seed, bucket, cp, cp_t, cp_eid, greatest"),
    "stream_late_swtc_estimate": f"SELECT seed, bucket, round(estimate, 6) AS estimate FROM ({_LATE_SWTC})",
    "stream_text_counts": f"""WITH {_HAND_PLAIN}, {_points(HAND.step)}, {_window(HAND)}, {_FREQ}, {_TRI}
SELECT bucket, cp_t, coalesce(n, 0)::BIGINT AS triangles FROM c LEFT JOIN (SELECT cp, sum(w) AS n FROM tri GROUP BY cp) USING (cp)""",
    "stream_swtc_estimate": f"SELECT seed, bucket, round(estimate, 6) AS estimate FROM ({_HAND_SWTC})",
    "stream_priority_sample": f"""WITH {_HAND_PLAIN}, se AS (SELECT *, 0 AS seed FROM e), {_slots(HAND_SAMPLE)}, now AS (SELECT max(t) AS t FROM e), ab AS (
  SELECT grp, slot, any_value(now.t) AS cp_t,
         max([priority, sl.t, eid, s, d]) FILTER (slice = (now.t - (grp - {HAND_SAMPLE.groups}) * {HAND_SAMPLE.window // HAND_SAMPLE.groups}) // {HAND_SAMPLE.window} - 1) AS a,
         max([priority, sl.t, eid, s, d]) FILTER (slice = (now.t - (grp - {HAND_SAMPLE.groups}) * {HAND_SAMPLE.window // HAND_SAMPLE.groups}) // {HAND_SAMPLE.window}) AS b
  FROM sl, now GROUP BY grp, slot
), v AS (SELECT grp, slot, CASE WHEN a IS NULL OR b[1] >= a[1] THEN b WHEN a[2] >= cp_t - {HAND_SAMPLE.window} THEN a END AS edge FROM ab)
SELECT grp, slot, edge[2] AS t, edge[3] AS eid, edge[4] AS s, edge[5] AS d FROM v WHERE edge IS NOT NULL""",
    "stream_bernoulli": f"WITH {_HAND_PLAIN} SELECT eid, t, s, d FROM e WHERE {_draw('sample', '0')} < {int(P * _M)}",
    "stream_window_stats": f"""WITH {_HAND_PLAIN} SELECT from_t, from_t + {HAND.window} AS to_t, count(*) AS instances
FROM (SELECT unnest(range((t // 43200) * 43200 - {HAND.window} + 43200, (t // 43200) * 43200 + 1, 43200)) AS from_t FROM e) GROUP BY ALL""",
}
