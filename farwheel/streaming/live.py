"""Live state: latest values, changes, the trip state machine and heading smoothing, in batch and as streams.

The step functions are pure and run per key in time order; `replay` applies them to a finished table, `advance_stream` to a
stream with a state a key."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

#: Metres: a fix off the line by more is off route; a stop counts as reached within REACHED.
OFF_ROUTE, REACHED = 150.0, 80.0
#: Metres a second: how fast a rider moves who is aboard, and how many fixes must say so.
ABOARD, VOTES = 7.5, 2
STATE = "fixes int, along double, votes int, aboard boolean, lat double, lon double, t double"
OUT = "trip_key long, event_id long, along double, aboard boolean, off_route boolean"


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; a map-side aggregate, no sort."""
    value = F.max(F.struct(*order, F.struct("*").alias("row")))
    return rows.groupBy(*keys).agg(value.alias("x")).select("x.row.*")


def changes(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__was", F.lag(value).over(w)).where(~F.col("__was").eqNullSafe(F.col(value))).drop("__was")


def metres(lat1: float, lon1: float, lat2: float, lon2: float) -> float:
    y = (lat2 - lat1) * 111194.9266
    x = (lon2 - lon1) * 111194.9266 * math.cos(math.radians((lat1 + lat2) / 2))
    return math.hypot(x, y)


def step(state: tuple | None, t: float, lat: float, lon: float) -> tuple[tuple, bool]:
    """The state after a fix, and whether it was off the line; progress never falls."""
    if state is None:
        return (1, 0.0, 0, False, lat, lon, t), False
    n, along, votes, aboard, la, lo, was = state
    d, s = metres(la, lo, lat, lon), t - was
    speed = d / s if 0.5 <= s <= 3600 else -1.0
    off = speed > 60
    votes = votes + 1 if speed >= ABOARD and not off else 0
    return (n + 1, along if off else along + d, votes, aboard or votes >= VOTES, lat, lon, t), off


def _rows(key: int, pdf: pd.DataFrame, state: tuple | None) -> tuple[list[tuple], tuple | None]:
    out = []
    for r in pdf.sort_values(["ts", "event_id"]).itertuples():
        state, off = step(state, r.ts.timestamp(), r.lat, r.lon)
        out.append((key, r.event_id, round(state[1], 3), state[3], off))
    return out, state


def replay(fixes: DataFrame) -> DataFrame:
    """The state machine over a table of (trip_key, ts, lat, lon, event_id)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_rows(key[0], pdf, None)[0], columns=["trip_key", "event_id", "along", "aboard", "off_route"])

    return fixes.groupBy("trip_key").applyInPandas(run, OUT)


def advance_stream(fixes: DataFrame, idle_ms: int = 3_600_000) -> DataFrame:
    """The same over a stream; a key's state goes after `idle_ms` without a fix."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.get if state.exists else None
        out, now = _rows(key[0], pd.concat(batches), now)
        state.update(now)
        state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(out, columns=["trip_key", "event_id", "along", "aboard", "off_route"])

    return fixes.groupBy("trip_key").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def smooth_headings(rows: DataFrame, k: float = 0.35, least_degrees: float = 1.0) -> DataFrame:
    """(vehicle, event_id, heading): exponential smoothing of unit vectors; only turns of a degree and more come out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out, x, y, last = [], None, None, None
        for r in pdf.sort_values(["ts", "event_id"]).itertuples():
            a, b = math.sin(math.radians(r.heading)), math.cos(math.radians(r.heading))
            x, y = (a, b) if x is None else (x + k * (a - x), y + k * (b - y))
            h = math.degrees(math.atan2(x, y)) % 360
            if last is None or min(abs(h - last), 360 - abs(h - last)) >= least_degrees:
                last = h
                out.append((r.vehicle, r.event_id, round(h, 3)))
        return pd.DataFrame(out, columns=["vehicle", "event_id", "heading"])

    return rows.groupBy("vehicle").applyInPandas(run, "vehicle long, event_id long, heading double")
