"""Riders followed along their journeys: the rules on a line of four stops, and batch against stream."""

from __future__ import annotations

import math
import random

import pytest

from farwheel.streaming import trips
from farwheel.streaming.trips import Rider, after, begin, legs_of, place, project

LAT, LON, STEP, PER_METRE = 45.07, 7.660, 0.002, 1 / 78650.0


def leg(kind, lons, departure, arrival, lat=LAT):
    along = [0.0]
    for a, b in zip(lons, lons[1:]):
        along.append(along[-1] + trips.metres(lat, a, lat, b))
    return kind, departure, arrival, [lat] * len(lons), list(lons), along


def plan(*legs):
    rows = [(i, la, lo, m, k > 0) for i, x in enumerate(legs) for k, (la, lo, m) in enumerate(zip(*x[3:]))]
    return [[x[0] for x in legs], [x[1] for x in legs], [x[2] for x in legs], *([r[c] for r in rows] for c in range(5))]


def journey(kind="ride", tail=False):
    legs = [leg("walk", [LON - 0.001, LON], 0.0, 60.0), leg(kind, [LON + i * STEP for i in range(4)], 60.0, 420.0)]
    if tail:
        legs.append(leg("walk", [LON + 3 * STEP, LON + 4 * STEP], 420.0, 600.0))
    return plan(*legs)


def riding(kind="ride", tail=False):
    legs = legs_of(journey(kind, tail))
    return legs, begin(legs, Rider(), 1)


def fed(legs, r, along, t0, t1, origin=LON, speed=-1.0, lat=LAT):
    boarded = None
    for t in range(t0, t1 + 1):
        was = r.leg
        r, _ = after(legs, r, float(t), "fix", lat, origin + along(t) * PER_METRE, 8.0, speed)
        if boarded is None and r.leg > was and legs[r.leg].kind != "walk":
            boarded = t
    return r, boarded


def bus(t0, start=0.0):
    return lambda t: start + (0.5 * (t - t0) ** 2 if 0 < t - t0 <= 11 else 0.0 if t <= t0 else 60.5 + 11 * (t - t0 - 11))


def test_stops_left_and_cues_once_each():
    legs, r = riding()
    seen = []
    for t, (k, speed) in enumerate([(0, 6), (1, 6), (2, 6), (3, 6), (3, 0.3)]):
        r, cue = after(legs, r, 10.0 * t, "fix", LAT, LON + k * STEP, 8.0, speed)
        seen.append((r.stops_left, cue, r.finished))
    assert seen == [(3, None, False), (2, None, False), (1, "one_stop_left", False), (0, "alight_now", False), (0, None, True)]


def test_poor_fix_holds_or_takes_the_vehicle():
    legs, r = riding()
    held, _ = place(legs, r, 5.0, LAT, LON + STEP, 120.0, 6.0)
    assert (held.along, held.estimated, held.leg) == (0.0, True, 1)
    seen, _ = place(legs, r._replace(vehicle_t=0.0, vehicle_lat=LAT, vehicle_lon=LON + STEP), 5.0, LAT, LON, 120.0, 6.0)
    assert seen.estimated and seen.along == pytest.approx(legs[1].along[1], abs=1)
    old, _ = place(legs, r._replace(vehicle_t=0.0, vehicle_lat=LAT, vehicle_lon=LON + STEP), 181.0, LAT, LON, 120.0, 6.0)
    assert old.along == 0.0


def test_projection_looks_a_bounded_way_ahead_and_never_back():
    x = riding()[0][1]
    assert project(x, LAT, LON + 3 * STEP, 0.0, 100.0)[0] < x.metres - 100
    assert project(x, LAT, LON + 3 * STEP, 0.0, math.inf)[0] == pytest.approx(x.metres, abs=1)
    assert project(x, LAT, LON, 200.0, 400.0)[0] == 200.0
    assert project(x, LAT, LON, x.metres + 1, 400.0)[1] == math.inf


def test_a_good_fix_outranks_a_guess_that_ran_ahead():
    legs, r = riding()
    ahead = r._replace(along=legs[1].along[3] - 1.0, estimated=True)
    assert place(legs, ahead, 5.0, LAT, LON + STEP, 8.0, 6.0)[0].along == pytest.approx(legs[1].along[1], abs=1)
    sure = ahead._replace(estimated=False)
    assert place(legs, sure, 5.0, LAT, LON + STEP, 8.0, 6.0)[0].along == sure.along


def test_timetable_after_twenty_seconds_follows_the_delay():
    legs, r = riding()
    r = r._replace(fix_t=400.0)
    assert after(legs, r, 419.0, "tick", math.nan, math.nan, math.nan, math.nan) == (r, None)
    on_time, cue = after(legs, r, 420.0, "tick", math.nan, math.nan, math.nan, math.nan)
    late, none = after(legs, r._replace(delay=300.0), 420.0, "tick", math.nan, math.nan, math.nan, math.nan)
    assert (on_time.stops_left, cue, on_time.estimated) == (0, "alight_now", True)
    assert late.stops_left > 0 and none is None
    walk = begin(legs, Rider(fix_t=0.0), 0)
    assert after(legs, walk, 60.0, "tick", math.nan, math.nan, math.nan, math.nan)[0].along == 0.0


def test_off_route_after_thirty_seconds_and_only_while_off():
    legs, r = riding()
    states = []
    for t, lat in [(0, LAT + 0.003), (29, LAT + 0.003), (30, LAT + 0.003), (31, LAT)]:
        r, _ = after(legs, r, float(t), "fix", lat, LON + STEP, 8.0, 6.0)
        states.append(r.off)
    assert states == [False, False, True, False]


def test_waiting_then_pulling_out_boards_within_seconds():
    legs = legs_of(journey())
    r, none = fed(legs, begin(legs, Rider(), 0), lambda t: 8.0, 0, 29, speed=0.0)
    assert none is None and r.leg == 0 and r.reached
    r, boarded = fed(legs, r, bus(30), 30, 70)
    assert boarded - 30 <= 15 and r.leg == 1 and r.along > 100


def test_sparse_fixes_need_two_votes():
    legs = legs_of(journey())
    r = begin(legs, Rider(), 0)
    for t, lon in [(0, 0.0001), (12, 0.0016)]:
        r, _ = after(legs, r, float(t), "fix", LAT, LON + lon, 8.0, -1.0)
    assert r.leg == 0 and r.votes == 1
    r, _ = after(legs, r, 22.0, "fix", LAT, LON + 0.0030, 8.0, -1.0)
    assert r.leg == 1 and r.along > 200


def test_what_does_not_board():
    legs = legs_of(journey())
    r, _ = fed(legs, begin(legs, Rider(), 0), lambda t: 0.0, 0, 9, speed=0.0)
    assert fed(legs, r, lambda t: 80.0, 10, 19)[1] is None  # a jump
    assert fed(legs, begin(legs, Rider(), 0), lambda t: 1.3 * t, 0, 120, speed=1.3)[1] is None  # a walker along the line
    assert fed(legs, r, lambda t: 11.0 * t, 10, 40, speed=11.0, lat=LAT + 0.003)[1] is None  # another street
    near = r._replace(vehicle_t=10.0, vehicle_lat=LAT, vehicle_lon=LON)
    assert after(legs, near, 11.0, "fix", LAT, LON, 8.0, 3.0)[0].leg == 0  # beside the bus


def test_change_on_one_street():
    legs = legs_of(plan(leg("ride", [7.650, 7.660], 0, 300), leg("walk", [7.660, 7.6596], 300, 330), leg("ride", [7.6596, 7.680], 600, 900)))
    r, cue = after(legs, begin(legs, Rider(), 0), 0.0, "fix", LAT, 7.6595, 8.0, 7.0)
    r = r._replace(along=legs[0].along[1] - 40)
    assert (r.leg, r.stops_left) == (0, 0) and cue == "alight_now"
    for t, lon, speed in [(0.5, 7.660, 0.0), (1, 7.6605, 0.8), (2, 7.6601, 0.2), (30, 7.6596, 1.0)]:
        r, _ = after(legs, r, float(t), "fix", LAT, lon, 8.0, speed)
        assert r.leg == 1
    assert r.reached
    r, boarded = fed(legs, r, bus(300), 290, 330, origin=7.6596)
    assert r.leg == 2 and boarded


def test_underground_takes_the_train_or_the_timetable_and_surfaces():
    legs, r = riding("metro", tail=True)
    far, _ = after(legs, r, 61.0, "fix", LAT + 0.01, LON, 8.0, 1.0)
    assert (far.off, far.estimated, far.along) == (False, True, 0.0)
    half, _ = after(legs, r, 310.0, "tick", math.nan, math.nan, math.nan, math.nan)
    assert half.along == pytest.approx(legs[1].along[2])
    train = r._replace(vehicle_t=305.0, vehicle_lat=LAT, vehicle_lon=LON + STEP)
    assert after(legs, train, 310.0, "tick", math.nan, math.nan, math.nan, math.nan)[0].along == pytest.approx(legs[1].along[1], abs=1)
    ended, cue = after(legs, train._replace(along=400.0, vehicle_lon=LON + 3 * STEP), 310.0, "tick", math.nan, math.nan, math.nan, math.nan)
    assert (ended.leg, ended.stops_left, cue) == (1, 0, "alight_now")
    up, _ = after(legs, half._replace(fix_t=300.0), 320.0, "fix", LAT, LON + 3 * STEP, 20.0, 1.0)
    assert up.leg == 2
    for lon, accuracy in [(LON + 3 * STEP, 31.0), (LON + 5 * STEP, 20.0)]:  # poor, or too far from the exit
        assert after(legs, half, 320.0, "fix", LAT, lon, accuracy, 1.0)[0].leg == 1
    assert after(legs, r, 100.0, "fix", LAT, LON + 3 * STEP, 20.0, 1.0)[0].leg == 1  # three stops left


def test_missed_only_while_walking_to_a_ride():
    legs = legs_of(journey())
    r = begin(legs, Rider(), 0)
    assert [trips.missed(legs, x, t) for x, t in [(r, 150.0), (r, 151.0), (r._replace(delay=60.0), 151.0), (begin(legs, r, 1), 999.0), (r._replace(finished=True), 999.0)]] == [False, True, False, False, False]


def table(spark, n=12, seed=5):
    """Random trips over two plans; in each a walk, a wait, the ride with poor, stray and missing fixes."""
    rng, rows, e = random.Random(seed), [], 0
    none = (None,) * 8
    for key in range(n):
        rows.append((key, -1, -1.0, "start", None, None, None, None, None, *journey("metro" if key % 3 == 0 else "ride", tail=key % 2 == 0)))
        for t in range(0, 140, 2):
            e += 1
            m = -78.0 + 1.3 * t if t < 60 else bus(60)(t)
            what = rng.choices(["fix", "tick", "vehicle", "delay", "next"], [80, 8, 8, 3, 1])[0]
            place = (LAT + rng.gauss(0, 1e-4), LON + m * PER_METRE) if rng.random() < 0.95 else (None, None) if what != "vehicle" else (LAT, LON)
            rows.append((key, e, float(t), what, *place, rng.choice([5.0, 20.0, 60.0, None]), rng.choice([None, -1.0, 1.0, 9.0]), float(rng.randint(0, 90)), *none))
    return spark.createDataFrame(rows, trips.EVENT)


def test_batch_equals_stream(spark, tmp_path):
    df = table(spark)
    whole = {r.event_id: tuple(r) for r in trips.follow(df).collect()}
    legs = [r[2] for r in whole.values()]
    assert max(legs) >= 1 and any(r[9] for r in whole.values()) and len(whole) == df.where("what in ('fix', 'tick', 'next')").count()
    for k, part in enumerate(["t < 40", "t >= 40 and t < 90", "t >= 90"]):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{k}"))
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in/*"))
        q = trips.follow_stream(stream, None).writeStream.format("memory").queryName("trips_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(60) and q.exception() is None
    finally:
        spark.conf.unset(key)
    assert {r.event_id: tuple(r) for r in spark.sql("SELECT * FROM trips_out").collect()} == whole


def test_no_plan_no_rows_and_empty_tables(spark):
    one = spark.createDataFrame([(1, 1, 0.0, "fix", LAT, LON, 5.0, 1.0)], "trip_key long, event_id long, t double, what string, lat double, lon double, accuracy double, speed double")
    assert trips.follow(trips.events(one)).count() == 0
    assert trips.follow(trips.events(one.limit(0))).count() == 0
    nameless = one.selectExpr("cast(null as long) as trip_key", "event_id", "t", "what")
    assert trips.events(nameless).count() == 0


def test_live_stats_against_brute_force(spark):
    from farwheel.streaming import stats

    rng = random.Random(11)
    times, delays, gone = [], [], set()
    for trip in range(40):
        start = rng.randrange(0, 6000, 30)
        times += [(trip, trip % 3, p, start + 100 * p, start + 100 * p - 20) for p in range(4)]
        delays += [(trip, p, rng.choice([-60, 0, 200])) for p in range(4) if rng.random() < 0.5]
        gone |= {(trip, p) for p in range(4) if rng.random() < 0.1}
    riders = [(k, k % 3, k % 2, k % 2 + 2, ["to_ride", "riding", "done"][k % 5 % 3], float(rng.randrange(0, 7000, 10)), 10.0 * k, 60.0, 9000.0, 9060.0) for k in range(60)]
    s = spark.createDataFrame(times, "trip_id long, pattern_id int, pos int, dep int, arr int")
    q = spark.createDataFrame(riders, "trip_key long, pattern_id int, from_pos int, to_pos int, state string, at double, metres_left double, walk_after double, planned_alight double, planned_arrival double")
    runs = stats.boards(q, s, spark.createDataFrame(delays, "trip_id long, pos int, delay int"), spark.createDataFrame(list(gone), "trip_id long, pos int"))
    got = {r.trip_key: tuple(r)[1:] for r in stats.live_stats(q, runs).collect()}
    late, dep, arr = {(t, p): x for t, p, x in delays}, {(t, p): x for t, _, p, x, _ in times}, {(t, p): x for t, _, p, _, x in times}
    want = {}
    for key, pattern, a, b, state, at, left, walk, alight, arrival in riders:
        mine = sorted((dep[t, a] + late.get((t, a), 0), t, arr[t, b] + late.get((t, b), 0)) for t in range(40) if t % 3 == pattern)
        if state == "riding":
            near = min(mine, key=lambda x: abs(x[0] - at))
            alight = float(near[2]) if abs(near[0] - at) <= 900 else alight
            want[key] = (left, None, None, None, None, alight, alight + walk)
        elif state == "to_ride":
            free = [x for x in mine if x[0] >= at and not {(x[1], a), (x[1], b)} & gone][:2]
            two = [*free, None, None][:2]
            want[key] = (left, *(y for x in two for y in ((x[1], x[0]) if x else (None, None))), None, free[0][2] + walk if free else arrival)
        else:
            want[key] = (left, None, None, None, None, None, arrival)
    assert got == want


def test_a_vehicle_without_a_place_is_passed_over(spark):
    none, fix = (None,) * 8, (LAT, LON + STEP, 200.0, 5.0)
    rows = [(1, -1, -1.0, "start", None, None, None, None, None, *journey()), (1, 0, 0.0, "next", None, None, None, None, None, *none)]
    rows += [(1, 1, 5.0, "vehicle", None, None, None, None, None, *none), (1, 2, 6.0, "fix", *fix, None, *none), (1, 3, 7.0, "fix", math.inf, 0.0, 5.0, 1.0, None, *none)]
    got = {r.event_id: r for r in trips.follow(spark.createDataFrame(rows, trips.EVENT)).collect()}
    assert {e: (r.leg, r.finished, r.cue) for e, r in got.items()} == {0: (1, False, None), 2: (1, False, None), 3: (1, False, None)}
