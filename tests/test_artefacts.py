"""Artefacts, the stream of positions, drawn segments and flattened journeys on small fixtures."""

from __future__ import annotations

import json
from datetime import datetime

import pytest

from farwheel.operators import features
from farwheel.sources import artefacts, positions


def test_artefact_round_trip_and_refusals(spark, tmp_path):
    rows = spark.createDataFrame([(1, "à"), (2, None), (2, None)], "id long, name string")
    path = f"file://{tmp_path}/a"
    assert artefacts.read(spark, path, "index") is None
    artefacts.write(rows, path, "index", "v2")
    assert sorted(map(tuple, artefacts.read(spark, path, "index").collect()), key=str) == [(1, "à"), (2, None), (2, None)]
    assert artefacts.read(spark, path, "lines") is None and artefacts.read(spark, path, "index", (2,)) is None
    rows.limit(1).write.mode("append").parquet(f"{path}/rows")
    assert artefacts.read(spark, path, "index") is None
    empty = f"file://{tmp_path}/e"
    artefacts.write(rows.where("id > 5"), empty, "index", "v2")
    assert artefacts.read(spark, empty, "index").count() == 0


def test_digest_knows_rows_not_order(spark):
    one = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string")
    other = spark.createDataFrame([("y", 2), ("x", 1)], "b string, a int").repartition(2)
    assert artefacts.digest(one).first() == artefacts.digest(other).first()
    assert artefacts.digest(one).first() != artefacts.digest(one.union(one.limit(1))).first()
    null, text = spark.createDataFrame([(None,)], "b string"), spark.createDataFrame([("",)], "b string")
    assert artefacts.digest(null).first() != artefacts.digest(text).first()


def test_lines_need_one_signature(spark, tmp_path):
    v = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "line long, i int")
    sig = spark.createDataFrame([(1, "a"), (2, "b")], "line long, signature string")
    artefacts.write_lines(v, sig, f"file://{tmp_path}/ok", "1")
    assert artefacts.read_lines(spark, f"file://{tmp_path}/ok").count() == 3
    for bad in (sig.where("line = 1"), sig.union(sig)):
        with pytest.raises(ValueError):
            artefacts.write_lines(v, bad, f"file://{tmp_path}/bad", "1")


def test_walk_graph_checks_its_ends(spark, tmp_path):
    nodes = spark.createDataFrame([(0, 1, 1), (1, 2, 2)], "node long, lat_e5 int, lon_e5 int")
    edges = spark.createDataFrame([(0, 0, 1, 0, "")], "edge long, a long, b long, flags int, name string")
    artefacts.write_walk_graph(nodes, edges, f"file://{tmp_path}/g", "1")
    assert artefacts.read_walk_graph(spark, f"file://{tmp_path}/g")[1].count() == 1
    artefacts.write_walk_graph(nodes.where("node = 0"), edges, f"file://{tmp_path}/h", "1")
    assert artefacts.read_walk_graph(spark, f"file://{tmp_path}/h") is None


def test_position_stream(spark, tmp_path):
    at = "2026-03-01T08:00:0{}Z"
    fixes = [
        {"trip_key": "a", "at": at.format(1), "lat": 45.0, "lon": 7.6, "accuracy": 5.0, "speed": 1.0, "heading": 370.0},
        {"trip_key": "a", "at": at.format(1), "lat": 45.0, "lon": 7.6, "accuracy": 5.0, "speed": 1.0, "heading": 370.0},
        {"trip_key": "a", "at": at.format(2), "lat": 45.0, "lon": 7.6, "heading": -1.0},
        {"trip_key": "b", "at": at.format(2), "lat": 95.0, "lon": 7.6},
        {"trip_key": None, "at": at.format(2), "lat": 45.0, "lon": 7.6},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(map(json.dumps, fixes)))
    q = positions.position_stream(spark, f"file://{tmp_path}/in").writeStream.format("memory").queryName("fixes_in").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.trip_key, r["at"], r.heading) for r in spark.table("fixes_in").collect())
    assert [(k, h) for k, _, h in got] == [("a", 10.0), ("a", None)] and isinstance(got[0][1], datetime)


def test_drawn_segments(spark):
    hops = spark.createDataFrame([(0, 1, 2, "4", 0), (0, 2, 1, "9", 2), (3, 1, 2, "10", 1), (3, 2, 2, "10", 1)], "mode int, from_node long, to_node long, route string, tier int")
    nodes = spark.createDataFrame([(1, 45.0, 7.6), (2, 45.1, 7.7)], "node long, lat double, lon double")
    got = {r.draw_rank: json.loads(r.feature) for r in features.segment_features(hops, nodes).collect()}
    tram, bus = got[0]["properties"], got[1]["properties"]
    assert len(got) == 2 and got[0]["geometry"] == {"type": "LineString", "coordinates": [[7.6, 45.0], [7.7, 45.1]]}
    assert (tram["mode"], tram["routes"], tram["n"], tram["tier"], tram["arrow"], tram["shade"]) == ("tram", "4,9", 2, 0, 0, -1)
    assert (bus["mode"], bus["n"], bus["tier"], bus["arrow"]) == ("bus", 1, 1, 1) and bus["shade"] >= 0


def test_live_route(spark):
    kind = "trip_key long, leg int, kind string, pattern_id int, from_pos int, to_pos int, from_lat double, from_lon double, to_lat double, to_lon double"
    legs = spark.createDataFrame([(1, 0, "walk", None, None, None, 45.0, 7.6, 45.0, 7.6), (1, 1, "ride", 5, 1, 3, 45.0, 7.6, 45.02, 7.6)], kind)
    ps = spark.createDataFrame([(5, p, p) for p in range(5)], "pattern_id int, pos int, stop_id long")
    stops = spark.createDataFrame([(0, 44.99, 7.6), (1, 45.0, 7.6), (2, 45.0, 7.6), (3, 45.01, 7.6), (4, 45.02, 7.6)], "stop_id long, lat double, lon double")
    got = sorted((r.leg, r.i, round(r.along)) for r in features.live_route(legs, ps, stops).collect())
    assert got == [(0, 0, 0), (1, 0, 0), (1, 2, 1112)]
