"""Following riders along their journeys: legs, stops left, cues, boarding by votes, underground rides; in batch and as a stream.

One table of events feeds both: (trip_key, event_id, t seconds, what, lat, lon, accuracy, speed, delay, and the PLAN columns). `what` is
'start' (carries the plan), 'fix', 'tick' (a timer), 'next' (the rider says so), 'vehicle' (where the ride's own vehicle is) or
'delay'. Every fix, tick and command gives one row, OUT. `follow` folds a finished table, trip after trip in sorted Arrow batches;
`follow_stream` holds the same state per trip under `transformWithStateInPandas`, so a trip's plan is sent once and each
micro-batch reads its own events alone.

Defined: events before a trip's plan give no row, a second plan starts anew; a fix without a place counts as a tick, a vehicle
without one is passed over; null accuracy is poor, null speed is taken from the fix before; events of one time go by event_id; a stream passes over events
older than the last one that it has applied; a null trip_key goes.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from farwheel.operators import grouped

# Metres, seconds and metres a second of the rules.
POOR, ON_ROUTE, OFF_ROUTE, OFF_FOR, AHEAD = 50.0, 60.0, 150.0, 30.0, 400.0
AT_STOP, ALIGHT, WALK_END = 60.0, 60.0, 25.0
PAST_STOP, STEP_SPEED, TRAIL_FOR, TRAIL_SPAN, TRAIL_SPEED, VOTES = 60.0, 2.0, 30.0, 6.0, 7.5, 2
SURFACED, SURFACED_ACCURACY, NO_FIX, MISSED, VEHICLE_FOR = 150.0, 30.0, 20.0, 90.0, 180.0
WALK_SPEED, FASTER, WARN_STOPS, NEVER = 1.2, 1.6, 1, -1e18

PLAN = "kinds array<string>, departures array<double>, arrivals array<double>, leg_of array<int>, lats array<double>, lons array<double>, alongs array<double>, at_stop array<boolean>"
EVENT = f"trip_key long, event_id long, t double, what string, lat double, lon double, accuracy double, speed double, delay double, {PLAN}"
OUT = "trip_key long, event_id long, leg int, along double, to_end double, stops_left int, estimated boolean, off_route boolean, votes int, cue string, missed boolean, finished boolean"
_PLAN_NAMES, _EVENT_NAMES, _OUT_NAMES = ([x.split()[0] for x in schema.split(", ")] for schema in (PLAN, EVENT, OUT))


class Leg(NamedTuple):
    kind: str  # 'walk', 'ride' or 'metro'
    departure: float
    arrival: float
    lat: list[float]
    lon: list[float]
    along: list[float]  # rises
    stops: list[float]  # metres at the stops after boarding

    @property
    def metres(self) -> float:
        return self.along[-1]

    def left(self, at: float) -> int:
        """Stops ahead of the last vertex at or before this place."""
        vertex = self.along[max(0, bisect_right(self.along, at + 0.01) - 1)]
        return len(self.stops) - bisect_right(self.stops, vertex)


class Rider(NamedTuple):
    t: float = NEVER
    fix_t: float = NEVER
    fix_lat: float = 0.0
    fix_lon: float = 0.0
    leg: int = 0
    along: float = 0.0
    to_end: float = 0.0
    stops_left: int = 0
    estimated: bool = False
    off_since: float = NEVER
    off: bool = False
    finished: bool = False
    reached: bool = False  # the stop of the next ride
    waited: float = -1.0  # metres on that ride where the rider waits
    trail_t: tuple[float, ...] = ()
    trail_along: tuple[float, ...] = ()
    votes: int = 0
    vehicle_t: float = NEVER
    vehicle_lat: float = 0.0
    vehicle_lon: float = 0.0
    delay: float = 0.0


RIDER = ", ".join(f"{k} {'array<double>' if k.startswith('trail') else {float: 'double', int: 'int', bool: 'boolean'}[type(v)]}" for k, v in Rider._field_defaults.items())


def legs_of(plan: list[Any]) -> list[Leg]:
    kinds, departures, arrivals, of, *vertices = plan
    out = []
    for i, kind in enumerate(kinds):
        lat, lon, along, stop = ([x for x, leg in zip(column, of, strict=True) if leg == i] for column in vertices)
        out.append(Leg(str(kind), float(departures[i]), float(arrivals[i]), *([float(x) for x in column] for column in (lat, lon, along)), [float(m) for m, s in zip(along, stop, strict=True) if s]))
    return out


def metres(lat: float, lon: float, to_lat: float, to_lon: float) -> float:
    a, b = math.radians(lat), math.radians(to_lat)
    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(to_lon - lon) / 2) ** 2
    return 2 * 6_371_000.0 * math.asin(min(1.0, math.sqrt(h)))


def project(leg: Leg, lat: float, lon: float, start: float, ahead: float) -> tuple[float, float]:
    """(metres along the leg, metres off it) of the nearest point on the segments from `start` to `ahead` metres further."""
    along, scale = leg.along, math.cos(math.radians(lat)) * 111_320.0
    best, least = start, math.inf
    for k in range(max(0, bisect_left(along, start) - 1), len(along) - 1):  # a leg's few segments; arrays would cost more
        if along[k] > start + ahead:
            break
        x, y = (leg.lon[k] - lon) * scale, (leg.lat[k] - lat) * 110_540.0
        dx, dy = (leg.lon[k + 1] - lon) * scale - x, (leg.lat[k + 1] - lat) * 110_540.0 - y
        long = dx * dx + dy * dy
        share = min(1.0, max(0.0, -(x * dx + y * dy) / long)) if long else 0.0
        off = math.hypot(x + share * dx, y + share * dy)
        if off < least:
            best, least = along[k] + share * (along[k + 1] - along[k]), off
    return max(start, best), least


def begin(legs: list[Leg], r: Rider, leg: int) -> Rider:
    """The rider at the start of a leg, or at the journey's end."""
    if leg >= len(legs):
        return r._replace(finished=True, to_end=0.0, stops_left=0)
    fresh = Rider()
    kept = {k: getattr(r, k) for k in ("t", "fix_t", "fix_lat", "fix_lon", "estimated", "vehicle_t", "vehicle_lat", "vehicle_lon", "delay")}
    return fresh._replace(**kept, leg=leg, to_end=legs[leg].metres, stops_left=len(legs[leg].stops))


def cue_of(before: int, left: int) -> str | None:
    if left == 0:
        return "alight_now" if before > 0 else None
    return "one_stop_left" if left <= WARN_STOPS < before else None


def vote(ride: Leg, r: Rider, t: float, lat: float, lon: float, near: bool, good: bool) -> Rider:
    """A walker's evidence of being aboard the next ride: on its path, past the stop and where they waited, as fast as a vehicle."""
    at, off = project(ride, lat, lon, 0.0, ride.metres)
    r = r._replace(reached=r.reached or near)
    if off > ON_ROUTE:
        return r
    if near and (r.waited < 0 or at < r.waited):
        r = r._replace(waited=at)
    if not good:
        return r
    recent = [(s, m) for s, m in zip(r.trail_t, r.trail_along, strict=True) if t - s <= TRAIL_FOR]
    step = t - r.trail_t[-1] if r.trail_t else 0.0
    onward = step > 0 and (at - r.trail_along[-1]) / step >= STEP_SPEED
    fast = any(t - s >= TRAIL_SPAN and (at - m) / (t - s) >= TRAIL_SPEED for s, m in recent)
    past = at >= max(0.0, r.waited) + PAST_STOP
    trail = [*recent, (t, at)]
    return r._replace(trail_t=tuple(s for s, _ in trail), trail_along=tuple(m for _, m in trail), votes=r.votes + 1 if past and onward and fast else 0)


def place(legs: list[Leg], r: Rider, t: float, lat: float, lon: float, accuracy: float, speed: float) -> tuple[Rider, str | None]:
    """The rider after a fix, and the cue that it gives. Progress on a leg only grows, but for a good fix after a guess."""
    leg, was = legs[r.leg], r
    guess, good = False, accuracy <= POOR
    r = r._replace(fix_t=t)
    if not good:
        if t - r.vehicle_t > VEHICLE_FOR:
            return r._replace(estimated=True), None
        lat, lon, guess = r.vehicle_lat, r.vehicle_lon, True
    at, off = project(leg, lat, lon, r.along, AHEAD)
    if was.estimated and good and off > ON_ROUTE:
        whole = project(leg, lat, lon, 0.0, leg.metres)
        at, off = whole if whole[1] <= ON_ROUTE else (at, off)
    if off > ON_ROUTE:
        at, guess = r.along, True
    to_stop = metres(lat, lon, leg.lat[-1], leg.lon[-1])
    to_end = min(leg.metres - at, to_stop) if guess else leg.metres - at
    r = r._replace(along=at, to_end=to_end, stops_left=leg.left(at), estimated=guess)

    if leg.kind == "walk":
        r = r._replace(off=False, off_since=NEVER)
        if r.leg + 1 < len(legs) and legs[r.leg + 1].kind != "walk":
            r = vote(legs[r.leg + 1], r, t, lat, lon, to_stop <= AT_STOP, good)
            return place(legs, begin(legs, r, r.leg + 1), t, lat, lon, accuracy, speed) if r.votes >= VOTES else (r, None)
        return (begin(legs, r, r.leg + 1), None) if to_stop <= WALK_END else (r, None)

    since = NEVER if off <= OFF_ROUTE else t if was.off_since == NEVER else was.off_since
    r = r._replace(off_since=since, off=since != NEVER and t - since >= OFF_FOR)
    if to_stop > ALIGHT:
        return r, cue_of(was.stops_left, r.stops_left)
    cue = "alight_now" if was.stops_left > 0 else None
    if speed > WALK_SPEED * FASTER:  # still aboard
        return r._replace(stops_left=0), cue
    return begin(legs, r, r.leg + 1), cue


def timetable(legs: list[Leg], r: Rider, t: float) -> tuple[Rider, str | None]:
    """Rides only, forward only: the last vertex that the delayed timetable has passed."""
    leg, r = legs[r.leg], r._replace(estimated=True)
    if leg.kind == "walk" or leg.arrival <= leg.departure:
        return r, None
    share = min(1.0, max(0.0, (t - leg.departure - r.delay) / (leg.arrival - leg.departure)))
    at = leg.along[bisect_right(leg.along, leg.metres * share) - 1]
    if at <= r.along:
        return r, None
    left = leg.left(at)
    return r._replace(along=at, to_end=leg.metres - at, stops_left=left), cue_of(r.stops_left, left)


def underground(legs: list[Leg], r: Rider, t: float) -> tuple[Rider, str | None]:
    """No fixes there: the train's own place, else the timetable. Never off route, and no leg ends by itself."""
    r = r._replace(off=False, off_since=NEVER)
    if t - r.vehicle_t > VEHICLE_FOR:
        return timetable(legs, r, t)
    moved, cue = place(legs, r, t, r.vehicle_lat, r.vehicle_lon, 10.0, 10.0)
    return moved._replace(fix_t=r.fix_t, estimated=True, off=False, off_since=NEVER), cue


def after(legs: list[Leg], r: Rider, t: float, what: str, lat: float, lon: float, accuracy: float, speed: float) -> tuple[Rider, str | None]:
    """The rider after a fix, a tick or a command."""
    if r.finished:
        return r, None
    if what == "next":
        return begin(legs, r, r.leg + 1), None
    leg = legs[r.leg]
    if what != "fix" or not (math.isfinite(lat) and math.isfinite(lon)):
        if leg.kind == "metro":
            return underground(legs, r, t)
        return timetable(legs, r, t) if r.fix_t != NEVER and t - r.fix_t >= NO_FIX else (r, None)
    accuracy = math.inf if math.isnan(accuracy) else accuracy
    if math.isnan(speed) or speed < 0:
        gap = t - r.fix_t
        speed = metres(r.fix_lat, r.fix_lon, lat, lon) / gap if 0.5 <= gap <= 30 else -1.0
    r = r._replace(fix_lat=lat, fix_lon=lon)
    if leg.kind != "metro":
        return place(legs, r, t, lat, lon, accuracy, speed)
    r, cue = underground(legs, r, t)
    if accuracy <= SURFACED_ACCURACY and r.stops_left <= 1 and metres(lat, lon, leg.lat[-1], leg.lon[-1]) <= SURFACED:
        r = begin(legs, r, r.leg + 1)
        return (r._replace(fix_t=t), cue) if r.finished else place(legs, r, t, lat, lon, accuracy, speed)
    return r._replace(fix_t=t), cue


def missed(legs: list[Leg], r: Rider, t: float) -> bool:
    """Whether a walker's next ride left too long ago."""
    if r.finished or legs[r.leg].kind != "walk" or r.leg + 1 >= len(legs) or legs[r.leg + 1].kind == "walk":
        return False
    return t - (legs[r.leg + 1].departure + r.delay) > MISSED


def fold(events: Iterable[tuple], plan: list[Any] | None, rider: Rider | None) -> tuple[list[tuple], list[Any] | None, Rider | None]:
    """The rows of one trip's events (tuples of EVENT by t and event_id, NaN for null numbers), and its plan and rider after them."""
    out: list[tuple] = []
    r, legs = rider, legs_of(plan) if plan is not None else []
    for trip_key, event_id, t, what, lat, lon, accuracy, speed, delay, *planned in events:
        if what == "start":
            plan = [list(x) for x in planned]
            legs = legs_of(plan)
            r = begin(legs, Rider(), 0)._replace(t=t)
            continue
        if r is None or t < r.t:
            continue
        r = r._replace(t=t)
        if what == "vehicle":
            if math.isfinite(lat) and math.isfinite(lon):
                r = r._replace(vehicle_t=t, vehicle_lat=lat, vehicle_lon=lon)
        elif what == "delay":
            r = r._replace(delay=delay)
        else:
            r, cue = after(legs, r, t, what, lat, lon, accuracy, speed)
            out.append((trip_key, event_id, r.leg, r.along, r.to_end, r.stops_left, r.estimated, r.off, r.votes, cue, missed(legs, r, t), r.finished))
    return out, plan, r


def plans(route: DataFrame, times: DataFrame) -> DataFrame:
    """(trip_key, PLAN) of vertices (trip_key, leg, kind, i, lat, lon, along, at_stop) and leg times (trip_key, leg, departure, arrival)."""
    v = route.groupBy("trip_key").agg(F.array_sort(F.collect_list(F.struct("leg", "i", "lat", "lon", "along", "at_stop"))).alias("v"))
    kinds = route.select("trip_key", "leg", "kind").distinct().join(times, ["trip_key", "leg"])
    k = kinds.groupBy("trip_key").agg(F.array_sort(F.collect_list(F.struct("leg", "kind", "departure", "arrival"))).alias("k"))
    cols = {"kinds": "k.kind", "departures": "k.departure", "arrivals": "k.arrival", "leg_of": "v.leg", "lats": "v.lat", "lons": "v.lon", "alongs": "v.along", "at_stop": "v.at_stop"}
    return v.join(k, "trip_key").select("trip_key", *(F.col(c).alias(name) for name, c in cols.items()))


def events(*parts: DataFrame) -> DataFrame:
    """Tables of some of EVENT's columns as one, the others null."""
    schema = [x.rsplit(" ", 1) for x in EVENT.split(", ")]
    rows = [p.select(*((F.col(n) if n in p.columns else F.lit(None)).cast(t).alias(n) for n, t in schema)) for p in parts]
    out = rows[0]
    for p in rows[1:]:
        out = out.unionByName(p)
    return out.where("trip_key is not null and t is not null")


def follow(table: DataFrame) -> DataFrame:
    """OUT of a finished table of EVENT."""

    def run(**columns: list) -> list[tuple]:
        for c in ("lat", "lon", "accuracy", "speed", "delay"):
            columns[c] = [math.nan if x is None else x for x in columns[c]]
        return fold(zip(*(columns[n] for n in _EVENT_NAMES), strict=True), None, None)[0]

    rows = table.select(*_EVENT_NAMES).where("trip_key is not null and t is not null")
    return grouped.by_key(rows, "trip_key", ["t", "event_id"], run, OUT)


class _Follow(StatefulProcessor):
    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.plan = handle.getValueState("plan", PLAN, self.idle_ms)
        self.rider = handle.getValueState("rider", RIDER, self.idle_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        plan = list(self.plan.get()) if self.plan.exists() else None
        r = None
        if self.rider.exists():
            r = Rider(*self.rider.get())
            r = r._replace(trail_t=tuple(r.trail_t), trail_along=tuple(r.trail_along))
        events = pd.concat(rows).sort_values(["t", "event_id"], kind="stable")
        out, plan, r = fold(zip(*(events[n].tolist() for n in _EVENT_NAMES), strict=True), plan, r)
        if plan is not None and r is not None:
            self.plan.update(tuple([x.item() if hasattr(x, "item") else x for x in column] for column in plan))
            self.rider.update(tuple(list(x) if isinstance(x, tuple) else x for x in r))
        yield pd.DataFrame(out, columns=_OUT_NAMES)

    def close(self) -> None:
        pass


def follow_stream(table: DataFrame, idle_ms: int | None = 86_400_000) -> DataFrame:
    """OUT of a stream of EVENT, with the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`). A trip's state
    goes `idle_ms` after its last event; as Spark then always has one more batch to run, such a stream needs a trigger by interval
    and never ends by itself. With None the state stays and `availableNow` ends."""
    return table.groupBy("trip_key").transformWithStateInPandas(_Follow(idle_ms), OUT, "append", "ProcessingTime" if idle_ms else "None")
