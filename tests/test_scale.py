"""Steps whose work once grew with hops, copies or pairs: the same results, in fewer jobs or rows."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from farwheel.operators import graph, grouped, paths, snapping, walks


def _jobs(spark, group, run):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
        return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_jobs_of_walks_do_not_grow_with_hops(spark):
    n = 90
    street = [(i, i, i + 1, i * 20.0, 0.0, i * 20.0 + 20, 0.0, 20.0, 20.0, 0, None) for i in range(n)]
    e = graph.cut(spark.createDataFrame(street, "edge long, a long, b long, ax double, ay double, bx double, by double, metres double, cost double, flags int, name string"))
    ask = spark.createDataFrame([(0, 1.0, 0.0, n * 20.0 - 1, 0.0)], "q long, x1 double, y1 double, x2 double, y2 double")
    got, jobs = _jobs(spark, "walks", lambda: walks.walk_routes(ask, e).collect())
    assert sorted(r.edge for r in got) == list(range(n)) and {round(r.cost, 6) for r in got} == {n * 20.0 - 2}
    assert jobs < 90


def test_tiles_find_what_rounds_find(spark):
    """Over several tiles, with equal costs on a grid and bounds."""
    rng, block, wide = random.Random(3), 150.0, 40
    hops, k = [], 0
    for x in range(wide):
        for y in range(3):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < wide and y + dy < 3 and rng.random() < 0.9:
                    a, b = x * 3 + y, (x + dx) * 3 + y + dy
                    for p, q, to in ((a, b, (x + dx, y + dy)), (b, a, (x, y))):
                        hops.append((p, q, k, block * (1 if rng.random() < 0.8 else 1.5), to[0] * block, to[1] * block))
                        k += 1
    e = spark.createDataFrame(hops, "a long, b long, edge long, cost double, bx double, by double")
    asks, goals = [], []
    for q in range(60):
        a, b = rng.randrange(wide), rng.randrange(wide)
        goal = (min(wide - 1, max(0, a + rng.randrange(-9, 10))), rng.randrange(3))
        for node in {a * 3 + rng.randrange(3), a * 3}:
            asks.append((q, node, rng.random() * 50, 1200.0 if b % 2 else 2500.0, goal[0] * block, goal[1] * block))
        asks[-1] = (*asks[-1][:3], asks[-2][3] if len(asks) > 1 and asks[-2][0] == q else asks[-1][3], *asks[-1][4:])
        goals += [(q, n, rng.random() * 20) for n in {goal[0] * 3 + goal[1], goal[0] * 3}]
    s = spark.createDataFrame(asks, "q long, node long, start double, limit double, gx double, gy double")
    g = spark.createDataFrame(goals, "q long, node long, tail double")
    ahead = F.greatest(F.lit(0.0), 0.9 * F.hypot(F.col("bx") - F.col("gx"), F.col("by") - F.col("gy")) - 160)
    area = F.lit(0).alias("area")
    want = paths.routes(e.select(area, "*"), s.select("*", area), goals=g, ahead=ahead).join(g.select("q", "node"), ["q", "node"])
    rows = lambda df: sorted((r.q, r.node, r.cost, tuple(r.path)) for r in df.select("q", "node", "cost", "path").collect())
    assert rows(want) and rows(paths.tile_routes(e, s, g, 2500.0, 0.9, 160.0)) == rows(want)


def test_groups_over_batches(spark):
    """Keys that end within a batch, go over several, and have one row."""
    rows = [(k, i, None if i % 3 else float(k)) for k, n in enumerate((1, 7, 2, 1, 12, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, v double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = grouped.by_key(df, "k", ["i"], lambda k, i, v: [(k[0], len(k), i == list(range(len(i))), v)], "k long, n long, sorted boolean, v array<double>").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.k, r.n) for r in got) == [(0, 1), (1, 7), (2, 2), (3, 1), (4, 12), (5, 3)]
    assert all(r.sorted and r.v == [None if i % 3 else float(r.k) for i in range(r.n)] for r in got)


def test_jobs_of_stop_chains_do_not_grow_with_hops(spark):
    n = 60
    roads = graph.cut(spark.createDataFrame([(i, i, i + 1, i * 20.0, 0.0, i * 20.0 + 20, 0.0, 20.0, 0.0, False) for i in range(n)], "edge long, a long, b long, ax double, ay double, bx double, by double, metres double, penalty double, service boolean"))
    stops = spark.createDataFrame([(1, 0, 5.0, 1.0), (1, 1, n * 20.0 - 5, 1.0)], "line long, stop long, x double, y double")
    got, jobs = _jobs(spark, "chain", lambda: snapping.stop_chain(stops, roads).orderBy("i").collect())
    assert [r.edge for r in got] == [-1, *range(n)] and jobs < 60


def test_boarded_runs_are_no_pairs(spark):
    from farwheel.queries_rows import boarded_run

    plan = boarded_run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.splitlines() if "Join " in x and "abs(" in x]


def test_spread_segments_are_not_broadcast(spark):
    """A segment is spread over many cells behind Spark's size check, so a side that looks small may be too large for the driver."""
    at = spark.range(1).selectExpr("id AS line", "0L AS k", "5D AS px", "1D AS py")
    seg = spark.range(1).selectExpr("id AS line", "0D AS ax", "0D AS ay", "9000D AS bx", "9000D AS by")
    plan = snapping.near_segments(at, seg, 20.0, ["line"])._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_streets_and_tracks_are_reckoned_in_doubles(spark):
    from farwheel import queries_drawn

    sf = "/root/testdata/sf0.001"
    kinds = {t for df in (queries_drawn.streets(spark, sf), queries_drawn.tracks(spark, sf)) for _, t in df.dtypes}
    assert not [t for t in kinds if t.startswith("decimal")]


def test_riders_are_folded_without_a_frame_a_trip(spark):
    from farwheel.streaming import trips

    plan = trips.follow(spark.createDataFrame([], trips.EVENT))._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroupsInPandas" not in plan


def test_a_round_sends_its_few_questions_to_the_timetable(spark, monkeypatch):
    """The timetable is neither shuffled nor written for them; where they are many, both sides are shuffled, with equal rows."""
    from farwheel import queries_journeys as q
    from farwheel.plans import planner

    sf = "/root/testdata/sf0.001"
    net = q.network(spark, sf)
    assert "RDD" not in net.runs._jdf.queryExecution().optimizedPlan().toString()
    labels = graph.cut(planner.seeds(q.requests(spark, sf), net.stops, 400.0))
    ride = lambda: planner.ride(labels, net.pattern_stops, net.runs, net.stop_times)
    few = ride()
    assert few._jdf.queryExecution().optimizedPlan().toString().count("Hint=(strategy=broadcast)") >= 4
    monkeypatch.setattr(planner, "FEW", 0)
    rows = lambda df: sorted((r.request, r.stop_id, r.arr, r.walk, str(r.legs)) for r in df.collect())
    assert rows(few) and rows(few) == rows(ride())


def test_services_are_sent_to_the_rows(spark):
    """No shuffle by service, whose few values would each be a task, whatever the size check says."""
    from farwheel.operators import timetable

    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.createDataFrame([(1, "a"), (2, "b")], "trip_id long, service_id string")
        days = spark.createDataFrame([("a", dt.date(2024, 1, 10))], "service_id string, day date")
        on = timetable.service_runs(rows, days, F.lit("2024-01-10").cast("date"))
        assert "hashpartitioning" not in on._jdf.queryExecution().executedPlan().toString()
        assert [r.trip_id for r in on.collect()] == [1]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_nearest_along_is_the_least_gap(spark):
    """Ties to 6 decimals on both sides, ends of cells and stops beyond the radius, as all pairs give them."""
    from farwheel.operators import spatial

    rng = random.Random(5)
    stops = [(k, rng.choice((0.0, 99.9999997, 100.0, 250.5, 1000.0, round(rng.uniform(0, 900), 2)))) for k in range(60)]
    fixes = [(k, rng.choice((0.0, 100.0, 200.0, 150.5, 350.5, 100.0 + 4e-7, 149.9999998, 1100.0, 1100.0 + 3e-7, round(rng.uniform(0, 900), 3)))) for k in range(80)]
    want = {}
    for s, e in stops:
        near = [(round(abs(a - e), 6), k) for k, a in fixes if abs(a - e) <= 100]
        if near:
            want[s] = min(near)[1]
    got = spatial.nearest_along(spark.createDataFrame(stops, "stop_id long, expected double"), spark.createDataFrame(fixes, "event_id long, along double"))
    assert dict(map(tuple, got.collect())) == want
