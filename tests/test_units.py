"""Fixtures of a few rows for what the tables can't show."""

from __future__ import annotations

import datetime as dt
import re
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from farwheel.functions import text, times
from farwheel.operators import graph, paths, spatial, timetable
from farwheel.plans import planner
from farwheel.sources import gtfs, gtfs_rt, osm
from farwheel.streaming import live


def test_gtfs_zip(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "f.zip", "w") as z:
        z.writestr("in/stops.txt", '﻿stop_id,stop_name,stop_lat,stop_lon\na,"b,c ""d""",45.0,7.6\nx,,bad,7\n')
    assert gtfs.extract(str(tmp_path / "f.zip"), str(tmp_path / "out")) == ["stops.txt"]
    names = ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type"]
    got = gtfs.stops(gtfs.read_member(spark, str(tmp_path / "out"), "stops.txt", names)).collect()
    assert [(r.stop_id, r.name, r.lat) for r in got] == [("a", 'b,c "d"', 45.0)]
    assert gtfs.read_member(spark, str(tmp_path / "out"), "none.txt", names).count() == 0


def test_times(spark):
    df = spark.createDataFrame([("25:10:00",), ("7:05:09",), (" 08:00",), ("x",)], "t string")
    assert [r[0] for r in df.select(times.parse_gtfs_time(F.col("t"))).collect()] == [90600, 25509, 28800, None]
    one = spark.createDataFrame([(dt.date(2026, 3, 29), 90000)], "d date, s int").select(times.service_day_time(F.col("d"), F.col("s"))).first()[0]
    assert one == dt.datetime(2026, 3, 30, 1, 0)


def test_versions(spark):
    vs = ["0.9.0-beta.7", "0.9.0", "0.9.0-beta.14.1", "0.9.0-beta.14", "junk", "v0.10.0"]
    df = spark.createDataFrame([(v,) for v in vs], "v string")
    assert [r.v for r in df.orderBy(text.version_key(F.col("v"))).collect()] == ["junk", "0.9.0-beta.7", "0.9.0-beta.14", "0.9.0-beta.14.1", "0.9.0", "v0.10.0"]


def test_realtime_damage(spark):
    good = gtfs_rt.vehicle_message("v42", "t1", 45.0692, 7.6376, 100)
    gone = gtfs_rt.chunk(2, gtfs_rt.chunk(1, b"x") + gtfs_rt.number(2, 1))
    bad = gtfs_rt.chunk(2, b"\x0a\x7f")
    df = spark.createDataFrame([(good + gone + bad,)], "payload binary")
    assert [(r.id, r.trip_id, r.ts) for r in gtfs_rt.vehicles(df).collect()] == [("v42", "t1", 100)]
    late = spark.createDataFrame([(gtfs_rt.update_message("u", "t2", 3, -30, True, False),)], "payload binary")
    r = gtfs_rt.trip_updates(late).first()
    assert (r.trip_id, r.seq, r.delay, r.skipped, r.canceled) == ("t2", 3, -30, True, False)
    with pytest.raises(ValueError):
        list(gtfs_rt.entities(b"\x12\x7f"))


def test_opl_escapes(spark):
    df = spark.createDataFrame([("%20%a%2c%",)], "s string")
    assert df.select(osm.unescape(F.col("s"))).first()[0] == " a,"


def test_overtaking_and_last_stop(spark):
    st = spark.createDataFrame([(t, 0, 1, 0, "s", p, p + 1, p, d + 60 * p, d + 60 * p) for t, d in ((1, 28900), (2, 28850)) for p in range(3)], "trip_id long, pattern_id int, route_id int, dir int, service_id string, pos int, seq int, stop_id long, dep int, arr int")
    days = spark.createDataFrame([("s", dt.date(2024, 1, 10))], "service_id string, day date")
    last = spark.createDataFrame([(0, 2)], "pattern_id int, last_pos int")
    got = timetable.departures(st, last, days, "2024-01-10", 28800).orderBy("stop_id", "expected").collect()
    assert [(r.stop_id, r.trip_id) for r in got] == [(0, 2), (0, 1), (1, 2), (1, 1)]


def test_components_chain(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "node long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(59) if i != 29], "a long, b long")
    got = {r.node: r.component for r in graph.components(nodes, edges).collect()}
    assert got == {i: 0 if i < 30 else 30 for i in range(60)}


def test_shortest_paths(spark):
    e = spark.createDataFrame([(0, 1, 5.0), (1, 2, 5.0), (0, 2, 20.0), (2, 3, 50.0)], "a long, b long, metres double")
    s = spark.createDataFrame([(0,)], "source long")
    assert {(r.node, r.metres) for r in paths.within_cost(e, s, 30.0).collect()} == {(0, 0.0), (1, 5.0), (2, 10.0)}


def test_plan_transfer(spark):
    stops = spark.createDataFrame([(0, "A", 45.0, 7.6), (1, "B", 45.001, 7.6), (2, "C", 45.02, 7.6), (3, "D", 45.0236, 7.6)], "stop_id long, name string, lat double, lon double")
    ps = spark.createDataFrame([(0, 0, 0, False), (0, 1, 2, True), (1, 0, 1, False), (1, 1, 3, True)], "pattern_id int, pos int, stop_id long, is_last boolean")
    rows = [(10, 0, "s", 0, 0, 28800, 28800), (10, 0, "s", 1, 2, 29400, 29400), (11, 1, "s", 0, 1, 29100, 29100), (11, 1, "s", 1, 3, 29700, 29700)]
    st = spark.createDataFrame(rows, "trip_id long, pattern_id int, service_id string, pos int, stop_id long, dep int, arr int")
    days = spark.createDataFrame([("s", dt.date(2024, 1, 10))], "service_id string, day date")
    q = spark.createDataFrame([(1, 45.0, 7.6, 45.0236, 7.6, 28500)], "request int, lat double, lon double, to_lat double, to_lon double, depart int")
    got = planner.plan(q, stops, ps, st, days, "2024-01-10", max_transfers=0, radius=450.0).collect()
    assert {tuple(x.trip_id for x in r.legs if x.kind == "ride") for r in got} == {(11,)}  # less walking and earlier
    barred = spark.createDataFrame([(3,)], "stop_id long")
    got = planner.plan(q, stops, ps, st, days, "2024-01-10", max_transfers=0, radius=450.0, suspended=barred).collect()
    assert {tuple(x.trip_id for x in r.legs if x.kind == "ride") for r in got} == {(10,)}


def test_within_matches_brute_force(spark):
    pts = [(i, 45 + (i * 37 % 100) / 5000, 7.6 + (i * 61 % 100) / 5000) for i in range(100)]
    df = spark.createDataFrame(pts, "id long, lat double, lon double")
    got = {(r.id, r.id2) for r in spatial.within(df, spatial.second(df, "id", "lat", "lon"), 300).collect()}
    want = {(a, b) for a, x, y in pts for b, u, v in pts if live.metres(x, y, u, v) <= 299}
    most = {(a, b) for a, x, y in pts for b, u, v in pts if live.metres(x, y, u, v) <= 301}
    assert want <= got <= most


def test_live_stream(spark, tmp_path):
    rows = [(1, dt.datetime(2024, 1, 1, 8, 0, s), 45.0 + s * 0.0001, 7.6, s) for s in range(6)]
    df = spark.createDataFrame(rows, "trip_key long, ts timestamp, lat double, lon double, event_id long")
    whole = {r.event_id: (round(r.along, 2), r.aboard) for r in live.replay(df).collect()}
    for k in range(2):
        df.where(f"event_id div 3 = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = live.advance_stream(s).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: (round(r.along, 2), r.aboard) for r in spark.sql("SELECT * FROM live").collect()}
    assert set(got) == set(whole) and whole[5][1] is True
    assert pd.Series({k: v[0] for k, v in whole.items()}).is_monotonic_increasing


def test_names_claim_what_is_built():
    from farwheel import catalog

    claimed = {f"{kind}-{n}" for kind, ids in (re.match(r"([A-Z]+)-([0-9_]+)", x).groups() for x in catalog.QUERIES if re.match(r"[A-Z]+-[0-9]", x)) for n in ids.strip("_").split("_")}
    not_built = {"GRF-24", "STR-17", "SNK-04", "SNK-08", "SRC-23"}
    assert not claimed & not_built


def _network(spark, times_of_day, suspended=None, day="2024-10-05"):
    """A (45.0000, 7.6) and C two kilometres off, a run at each of these hours, ten minutes long."""
    stops = spark.createDataFrame([(1, 45.0, 7.6), (3, 45.02, 7.6)], "stop_id long, lat double, lon double")
    patterns = spark.createDataFrame([(0, 0, 1, False), (0, 1, 3, True)], "pattern_id int, pos int, stop_id long, is_last boolean")
    times_ = [(10 + k, 0, "s", p, s, h * 3600 + 600 * p, h * 3600 + 600 * p) for k, h in enumerate(times_of_day) for p, s in ((0, 1), (1, 3))]
    stop_times = spark.createDataFrame(times_, "trip_id long, pattern_id int, service_id string, pos int, stop_id long, dep int, arr int")
    days = spark.createDataFrame([("s", dt.date(2024, 10, 5))], "service_id string, day date")
    return planner.network(stops, patterns, stop_times, days, day)


def _ask(spark, **more):
    row = {"request": 1, "lat": 45.001, "lon": 7.6, "to_lat": 45.0201, "to_lon": 7.6, **more}
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if 'l' in k and 'deadline' not in k else 'int'}" for k in row).replace("request int", "request long"))


def test_arrive_by(spark):
    net = _network(spark, [7, 8, 9, 10])
    got = planner.arrive_by(_ask(spark, deadline=9 * 3600 + 900), net, max_transfers=1).collect()
    ride = next(x for x in got[0].legs if x.kind == "ride")
    assert len(got) == 1 and ride.dep == 9 * 3600 and got[0].legs[0].arr == 9 * 3600 - 120
    assert got[0].departure == got[0].legs[0].dep and got[0].arr <= 9 * 3600 + 900
    assert planner.arrive_by(_ask(spark, deadline=7 * 3600 + 300), net, max_transfers=1).count() == 0


def test_waits_have_no_limit(spark):
    got = planner.search(_ask(spark, depart=3 * 3600), _network(spark, [9]), 0).collect()
    assert [r.rides for r in got] == [1] and got[0].legs[1].dep == 9 * 3600


def test_reprice(spark):
    net = _network(spark, [8, 9])
    j = planner.search(_ask(spark, depart=8 * 3600 - 150), net, 0)
    assert j.first().legs[1].dep == 8 * 3600  # 125 s on foot by the estimate
    none = spark.createDataFrame([], "from_stop long, to_stop long, metres double")
    kept = planner.reprice(j, net, none, 1000.0).first()
    assert kept.legs[1].dep == 8 * 3600 and kept.walk == pytest.approx(j.first().walk * 1.35, abs=0.01)
    # an estimate whose walk ends later misses the ride by more than 30 s and takes the next
    slow = j.withColumn("legs", F.transform("legs", lambda x: F.when(x["kind"] == "walk", x.withField("walk", x["walk"] * 2)).otherwise(x)))
    late = planner.reprice(slow, net, none, 5000.0).first()
    assert late.legs[1].dep == 9 * 3600 and late.legs[1].trip_id == 11 and late.arr == late.legs[2].arr
    assert planner.reprice(slow, _network(spark, [8]), none, 5000.0).count() == 0
    assert planner.reprice(j, net, none, 10.0).count() == 0


def test_line_operators(spark):
    from farwheel.operators import lines

    def frame(rows):
        return spark.createDataFrame([(int(a), int(i), float(x), float(y)) for a, i, x, y in rows], "line long, i int, x double, y double")

    bent = frame([(1, 0, 0, 0), (1, 1, 50, 0.5), (1, 2, 100, 0), (1, 3, 100, 100), (2, 0, 0, 0), (2, 1, 0, 0)])
    assert sorted((r.line, r.i) for r in lines.simplified(bent).collect()) == [(1, 0), (1, 2), (1, 3), (2, 0), (2, 1)]
    parts = lines.split_at(bent.where("line = 1"), spark.createDataFrame([(1, 120.0)], "line long, cut double")).collect()
    ahead = sorted((r.i, round(r.x), round(r.y)) for r in parts if r.part == 1)
    assert ahead[0][1:] == (100, 20) and ahead[-1][1:] == (100, 100) and sum(r.part == 0 for r in parts) == 4
    spike = frame([(1, 0, 0, 0), (1, 1, 50, 0), (1, 2, 60, 0), (1, 3, 50, 0.2), (1, 4, 50, 60), (2, 0, 500, 0), (2, 1, 560, 0)])
    assert [(r.line, r.i) for r in lines.folds(spike).collect()] == [(1, 2)]
    loop = frame([(1, 0, 0, 0), (1, 1, 20, 0), (1, 2, 20, 20), (1, 3, 10, 20), (1, 4, 10, -50)])
    assert [(r.i, r.j) for r in lines.self_crossings(loop).collect()] == [(1, 4)]
    chain = frame([(2, 0, 20, 20), (2, 1, 90, 20)])  # another line attaches within the loop
    assert lines.self_crossings(loop.union(chain)).count() == 0
    drawn = frame([(10, 0, 0, 0), (10, 1, 100, 0), (11, 0, 100, 0.5), (11, 1, 200, 0), (12, 0, 200, 50), (12, 1, 300, 50)])
    path = frame([(1, 0, 0, 0), (1, 1, 100, 0.2), (1, 2, 200, 0), (1, 3, 250, 0), (2, 0, 0, 0), (2, 1, 100, 0)])
    assert sorted((r.line, r.i, r.kind) for r in lines.gaps(path, drawn).collect()) == [(1, 3, "missing")]
    apart = frame([(10, 0, 0, 0), (10, 1, 100, 0), (11, 0, 100, 1.5), (11, 1, 200, 1.5)])
    over = frame([(1, 0, 0, 0.8), (1, 1, 100, 0.8), (1, 2, 200, 0.8)])
    assert [(r.i, r.kind) for r in lines.gaps(over, apart).collect()] == [(1, "joint")]
    c = spark.createDataFrame([([(0.0, 9.0), (10.0, 4.0), (29.0, 5.0), (45.0, 1.0), (80.0, 2.0)],), ([],)], "c array<struct<pos:double,dist:double>>")
    assert [[tuple(x) for x in r[0]] for r in c.select(lines.local_minima(F.col("c"))).collect()] == [[(10.0, 4.0), (45.0, 1.0), (80.0, 2.0)], []]


def test_texts_of_places_and_alerts(spark):
    df = spark.createDataFrame([([("Hello", "en"), ("Ciao", "IT-it")],), ([("Salut", "fr"), (None, "it")],), ([],), ([("x", None)],)], "t array<struct<text:string,language:string>>")
    assert [r[0] for r in df.select(text.translation(F.col("t"))).collect()] == ["Ciao", "Salut", "", "x"]
    p = spark.createDataFrame([("Bar", "Via Po", "3", "Torino"), (None, "Via Po", None, "Torino"), (None, None, None, "Torino"), (None, None, "4", None)], "n string, s string, h string, c string")
    c = [F.col(x) for x in "nshc"]
    assert [tuple(r) for r in p.select(text.address_line(*c[1:]), text.place_name(*c)).collect()] == [("Via Po 3, Torino", "Bar"), ("Via Po, Torino", "Via Po"), ("Torino", "Torino"), ("", "?")]


def test_reprice_on_a_faster_line(spark):
    """A missed ride is boarded anew on whatever arrives first, though it leaves later; the timetable isn't copied for that."""
    net = _network(spark, [8, 9])
    st = net.stop_times
    asks = spark.createDataFrame([(st.where("pos = 0").first()["stop_id"], st.orderBy(F.desc("pos")).first()["stop_id"], 8 * 3600 + 1)], "from_stop long, to_stop long, t int")
    late = planner._earliest_arrivals(asks, net, 1).first()["run"]
    assert late.trip2 == 11 and late.dep2 == 9 * 3600
    # a run that leaves after the first and overtakes it
    quick = st.where("trip_id = 11").withColumn("trip_id", F.lit(77).cast("long")).withColumn("dep", F.lit(9 * 3600 + 5) + F.col("pos")).withColumn("arr", F.lit(9 * 3600 + 5) + F.col("pos"))
    both = st.unionByName(quick)
    runs = net.runs.unionByName(quick.select("trip_id", "pattern_id", "pos", F.col("dep").cast("int").alias("dep"), F.lit(0).alias("offset")))
    fast = planner._earliest_arrivals(asks, net._replace(stop_times=both, runs=runs), 1).first()["run"]
    assert fast.trip2 == 77 and fast.dep2 == 9 * 3600 + 5
    none = asks.withColumn("to_stop", F.lit(-5).cast("long"))
    assert planner._earliest_arrivals(none, net, 1).count() == 0


def test_times_with_other_signs(spark):
    """Plain texts take no pattern; others mean what they meant."""
    told = {"8:00:05": 28805, "25:1": 90060, "8:00": 28800, "-1:00:00": 3600, "a8:0b0:09": 28809, "8::5": None, "8:00:": 28800, "8": None, "": None, ":": None, " 7:30 ": 27000, "+7:30:x": 27000, "1:2:3:4": 3723, None: None}
    df = spark.createDataFrame([(k,) for k in told], "t string").select("t", times.parse_gtfs_time(F.col("t")).alias("s"))
    assert {r.t: r.s for r in df.collect()} == told
    plan = df.select(times.clock(F.lit(90061))).first()[0]
    assert plan == "25:01:01"
    whole = spark.range(5, 200000, 1234).select(F.col("id").cast("int").alias("id")).select("id", times.parse_gtfs_time(times.clock(F.col("id"))).alias("s"))
    assert whole.where("id <> s or s is null").isEmpty()


def test_lines_are_read_once(spark):
    """What filters and joins ask of a line's cells doesn't read the line again."""
    names = ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"]
    lines = spark.createDataFrame([('"1","a","3",,"8:00:01"',), ('"1","a","4",,',), ('"2","a","1","9:0:0",',), ('"1","b","x","9:0:0",',)], "line string")
    known = spark.createDataFrame([("1", "a"), ("1", "b")], "trip_id string, stop_id string")
    got = gtfs.stop_times(gtfs.parse_lines(lines, names, names), known.select("trip_id"), known.select("stop_id"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert [tuple(r) for r in got.collect()] == [("1", 3, "a", 28801, 28801)]
