"""Arrive-by: all moments at once find what passes one after the other find, however many."""

from __future__ import annotations

import datetime as dt
import random

from farwheel.plans import planner
from farwheel.streaming import live

ROOM = "pattern_id int, pos int, stop_id long, is_last boolean"


def _feed(spark, stops, lines, runs):
    """`lines`: the stops of each pattern; `runs`: (trip, pattern, first departure, seconds a hop)."""
    s = spark.createDataFrame([(k, *at) for k, at in stops.items()], "stop_id long, lat double, lon double")
    p = spark.createDataFrame([(k, i, x, i == len(line) - 1) for k, line in enumerate(lines) for i, x in enumerate(line)], ROOM)
    rows = [(trip, k, "s", i, x, at + hop * i, at + hop * i) for trip, k, at, hop in runs for i, x in enumerate(lines[k])]
    st = spark.createDataFrame(rows, "trip_id long, pattern_id int, service_id string, pos int, stop_id long, dep int, arr int")
    days = spark.createDataFrame([("s", dt.date(2024, 10, 5))], "service_id string, day date")
    return planner.network(s, p, st, days, "2024-10-05")


def test_a_busy_line_is_searched_to_its_last_run(spark):
    stops = {1: (45.0, 7.6), 3: (45.02, 7.6)}
    net = _feed(spark, stops, [[1, 3]], [(k, 0, 7 * 3600 + 200 * k, 600) for k in range(40)])  # far more runs than eight
    ask = spark.createDataFrame([(1, 45.001, 7.6, 45.0201, 7.6, 9 * 3600)], "request long, lat double, lon double, to_lat double, to_lon double, deadline int")
    got = planner.arrive_by(ask, net, max_transfers=1).collect()
    last = max(7 * 3600 + 200 * k for k in range(40) if 7 * 3600 + 200 * k + 600 + 13 <= 9 * 3600)
    assert [x.dep for r in got for x in r.legs if x.kind == "ride"] == [last]


def _passes(ask, stops, lines, runs, cap=1000.0):
    """Pass after pass on direct rides: (departure, arr, rounded walk) of the front."""
    q, lat, lon, to_lat, to_lon, deadline = ask
    walk = lambda m: round(m * 1.35 / 1.2)
    access = {k: m for k, at in stops.items() if (m := live.metres(lat, lon, *at)) <= 400}
    egress = {k: m for k, at in stops.items() if (m := live.metres(to_lat, to_lon, *at)) <= 400}
    t, found = deadline - 1800 - 3600, set()
    while t < deadline:
        done = []
        for k, line in enumerate(lines):
            for i, x in enumerate(line[:-1]):
                if x in access:
                    left = [(at + hop * i, trip, hop, at) for trip, p, at, hop in runs if p == k and at + hop * i >= t + walk(access[x])]
                    if left:
                        dep, trip, hop, at = min(left)
                        done += [(round(access[x] + egress[y], 3), at + hop * j + walk(egress[y]), dep, walk(access[x]), trip) for j, y in enumerate(line) if j > i and y in egress]
        done = [d for d in done if d[0] <= cap]
        fits = [d for d in done if d[1] <= deadline and not any(e[0] <= d[0] and e[1] <= d[1] and e[:2] != d[:2] for e in done)]
        if not fits:
            break
        found |= {(max(t, d[2] - 120 - d[3]), d[1], d[0]) for d in fits}
        t = min(d[2] - d[3] for d in fits) + 1
    front = {f for f in found if not any(g[0] >= f[0] and g[2] <= f[2] and (g[0] > f[0] or g[2] < f[2]) for g in found)}
    return {f for f in front if f[0] >= max(g[0] for g in front) - 3600}


def test_all_passes_at_once(spark, monkeypatch):
    rng = random.Random(2)
    stops = {k: (45.0 + k // 6 * 0.0013 + rng.random() * 0.0004, 7.6 + k % 6 * 0.0021 + rng.random() * 0.0004) for k in range(24)}
    lines = [rng.sample(range(24), 5) for _ in range(14)]
    runs = [(n, n % 14, 25200 + rng.randrange(9000), rng.choice((60, 90, 150, 200))) for n in range(500)]
    asks = [(q, 45.0 + rng.random() * 0.004, 7.6 + rng.random() * 0.004, 45.0 + rng.random() * 0.004, 7.607 + rng.random() * 0.004, 30600 + q * 300) for q in range(4)]
    net = _feed(spark, stops, lines, runs)
    df = spark.createDataFrame(asks, "request long, lat double, lon double, to_lat double, to_lon double, deadline int")
    want = {(a[0], d, arr, round(w, 1)) for a in asks for d, arr, w in _passes(a, stops, lines, runs)}
    assert len({r[0] for r in want}) == 4 and len(want) > 6
    rows = lambda: {(r.request, r.departure, r.arr, round(r.walk, 1)) for r in planner.arrive_by(df, net, max_transfers=0).collect()}
    monkeypatch.setattr(planner, "FEW", 10**9)
    assert rows() == want
    monkeypatch.setattr(planner, "FEW", 0)
    assert rows() == want


def test_the_front_weighs_rides_too(spark):
    rows = [(1, 100, 5.0, 2), (1, 100, 5.0, 1), (1, 90, 5.0, 1), (1, 90, 4.0, 2), (1, 80, 4.0, 1), (1, 80, 4.0, 3), (1, 110, 9.0, 3), (2, 10, 9.0, 3), (2, 10, 9.0, 3)]
    df = spark.createDataFrame(rows, "request long, departure int, walk double, rides int")
    want = [r for r in rows if not any(k[0] == r[0] and k[1] >= r[1] and k[2] <= r[2] and k[3] <= r[3] and k[1:] != r[1:] for k in rows)]
    assert sorted(map(tuple, planner._front(df, 3).collect())) == sorted(want)
