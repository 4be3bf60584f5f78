"""The history of the bounded sample as a stream of life events, with timers.

A place keeps the top of its slice before and that of its current slice. An arrival moves it on at once; where none comes,
event-time timers do: at the end of its slice, when the current top becomes that of the slice before, and when a valid edge
leaves the window. An event that time brings about carries the time from which on it holds; it takes effect with the first
arrival of the stream at or after that time, whichever place this belongs to."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trellisway.operators.sampling import SampleSpec, assign_slots, chunk_length, first_arrivals, first_of_times, replicate

#: State stores that hold timers.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}

_KEY = ["seed", "grp", "slot"]
_EDGE = ["priority", "t", "eid", "s", "d"]
_EVENT = [*_EDGE, "event", "at_t", "at_eid"]
EVENTS = "seed int, grp long, slot long, priority long, t long, eid long, s long, d long, event string, at_t long, at_eid long"
_TOP = ", ".join(f"{x}_{c} long" for x in "ab" for c in [*_EDGE, "valid"])


def _clock(time: int) -> int:
    """Milliseconds of event time; a second later than the stream's, as no row may be at the first watermark, which is 0."""
    return (time + 1) * 1000


class _Place:
    """One place: the tops of two slices, each an edge and whether it is valid now."""

    def __init__(self, grp: int, spec: SampleSpec, held: tuple | None):
        self.spec, self.begin = spec, (grp - spec.groups) * (spec.window // spec.groups)
        n = len(_EDGE) + 1
        self.slice, tops = (None, [None, None]) if held is None else (held[0], [held[1 : n + 1], held[n + 1 : 2 * n + 1]])
        self.a, self.b = (None if x is None or x[0] is None else [tuple(x[:-1]), bool(x[-1])] for x in tops)
        self.events: list[tuple] = []

    def state(self, timer: int | None) -> tuple:
        row = lambda x: (*[None] * len(_EDGE), None) if x is None else (*x[0], int(x[1]))
        return (self.slice, *row(self.a), *row(self.b), timer)

    def due(self) -> tuple[int, str] | None:
        """The next time at which time alone changes something. An edge leaves the window no later than its slice is the
        one before the last, so its end comes first of two at one time."""
        ends = [(x[0][1] + self.spec.window + 1, k) for k, x in (("a", self.a), ("b", self.b)) if x is not None and x[1]]
        if self.slice is not None and (self.a is not None or self.b is not None):
            ends.append((self.begin + self.spec.window * (self.slice + 1), "slice"))
        return min(ends, default=None)

    def until(self, now: int) -> None:
        while (due := self.due()) is not None and due[0] <= now:
            at, what = due
            if what == "slice":
                self.slice += 1
                self.a, self.b = self.b, None
                if self.a is not None and not self.a[1]:
                    self.a[1] = True
                    self.events.append((*self.a[0], "promoted", at, None))
            else:
                top = self.a if what == "a" else self.b
                top[1] = False
                self.events.append((*top[0], "expired", at, None))

    def insert(self, slice_: int, edge: tuple) -> None:
        self.until(edge[1])
        if self.slice != slice_:  # nothing was held any more
            self.slice, self.a, self.b = slice_, None, None
        if self.b is not None and edge[0] < self.b[0][0]:
            return
        starts = self.a is None or edge[0] >= self.a[0][0]
        for old in (self.b, self.a if starts else None):
            if old is not None and old[1]:
                old[1] = False
                self.events.append((*old[0], "replaced", edge[1], edge[2]))
        self.b = [edge, starts]
        if starts:
            self.events.append((*edge, "started", edge[1], edge[2]))


class _Lives(StatefulProcessor):
    def __init__(self, spec: SampleSpec):
        self.spec = spec

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tops = handle.getValueState("tops", f"slice long, {_TOP}, timer long")

    def _moved(self, key: tuple, move: Any) -> Iterator[pd.DataFrame]:
        held = tuple(self.tops.get()) if self.tops.exists() else None
        place = _Place(int(key[1]), self.spec, None if held is None else held[:-1])
        move(place)
        before, due = None if held is None else held[-1], place.due()
        timer = None if due is None else due[0]
        if timer != before:
            if before is not None:
                self.handle.deleteTimer(_clock(before))
            if timer is not None:
                self.handle.registerTimer(_clock(timer))
        self.tops.update(place.state(timer))
        if place.events:
            rows = pd.DataFrame(place.events, columns=_EVENT).astype({c: "Int64" for c in _EVENT if c != "event"})
            yield rows.assign(**{k: int(v) for k, v in zip(_KEY, key, strict=True)})[[*_KEY, *_EVENT]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = sorted(tuple(map(int, r)) for part in rows for r in part[["t", "eid", "slice", "priority", "s", "d"]].itertuples(index=False, name=None))

        def move(place: _Place) -> None:
            for t, eid, slice_, priority, s, d in came:
                place.insert(slice_, (priority, t, eid, s, d))

        yield from self._moved(key, move)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        # all that is due, not only this timer: one that is set for a time gone by waits for the next batch
        now = timerValues.getCurrentWatermarkInMs() // 1000 - 1
        yield from self._moved(key, lambda place: place.until(now))

    def close(self) -> None:
        pass


def stream_life_events(stream: DataFrame, spec: SampleSpec, seeds: int, late: str = "1 second") -> DataFrame:
    """(seed, grp, slot, priority, t, eid, s, d, event, at_t, at_eid) for each edge of a stream of (eid, t, s, d), its times
    in seconds from 0 on: `started` and `replaced` with the arrival that did it; `promoted` and `expired` with the time from
    which on it holds and no id. A batch's edges are taken in order; rows that are `late` or more
    behind the newest of earlier batches are dropped, so the least that keeps rows of one time together is a second. Rows with a negative id raise the watermark and nothing else. Needs the conf STORE."""
    timed = stream.withColumn("ts", F.timestamp_seconds(F.col("t") + 1)).withWatermark("ts", late).where("eid >= 0")
    slotted = assign_slots(replicate(timed, seeds), spec).select(*_KEY, "slice", *_EDGE, "ts")
    return slotted.groupBy(*_KEY).transformWithStateInPandas(statefulProcessor=_Lives(spec), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def lives_of_events(events: DataFrame, edges: DataFrame, spec: SampleSpec) -> DataFrame:
    """(seed, grp, slot, priority, t, eid, s, d, start, end, expired, promoted): the lives, as sample_lifetimes has them,
    once the times of events have met the arrivals (t, eid) of `edges`. Stores no tables."""
    found = first_arrivals(first_of_times(edges), events.where("at_eid IS NULL").select(F.col("at_t").alias("x")), chunk_length(spec.window))
    own = F.when(F.col("at_eid").isNotNull(), F.struct(F.col("at_t").alias("t"), F.col("at_eid").alias("eid")))
    dated = events.join(found, (F.col("at_t") == F.col("x")) & F.col("at_eid").isNull(), "left").withColumn("moment", F.coalesce(own, "at"))
    begins = F.col("event").isin("started", "promoted")
    lives = dated.groupBy(*_KEY, *_EDGE).agg(F.min(F.when(begins, F.col("moment"))).alias("start"), F.min(F.when(~begins, F.col("moment"))).alias("end"), F.bool_or((F.col("event") == "expired") & F.col("moment").isNotNull()).alias("expired"), F.bool_or(F.col("event") == "promoted").alias("promoted"))
    return lives.where("start IS NOT NULL AND (end IS NULL OR end > start)")
