"""Queries over sources (SRC) and sinks (SNK): the feed is written in a format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.feed import table
from farwheel.functions import geo, text, times
from farwheel.operators import timetable
from farwheel.queries_groups import board
from farwheel.queries_scalars import r3
from farwheel.registry import query
from farwheel.sources import artefacts, gtfs, gtfs_rt, osm


def _csv(rows: DataFrame, *columns: str) -> DataFrame:
    cells = [F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')) for c in columns]
    return rows.select(F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in cells)).alias("line"))


@query("SRC-01_02_03_05_gtfs_stops", "SELECT CAST(stop_id AS VARCHAR) AS stop_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_stops")
def gtfs_stops(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stops(spark, sf)
    odd = s.withColumn("k", F.lit("0")).unionByName(s.withColumn("k", F.lit("1")))  # stations are no stops
    lines = _csv(odd.withColumn("extra", F.lit('a,"b"')), "lon", "stop_id", "extra", "raw_name", "lat", "k")
    got = gtfs.stops(gtfs.parse_lines(lines, ["﻿stop_lon", "stop_id ", "other", "stop_name", "stop_lat", "location_type"], ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "location_type"]))
    return got.select("stop_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query("SRC-04_06_gtfs_routes", "SELECT CAST(route_id AS VARCHAR) AS route_id, CASE WHEN route_id % 3 = 0 THEN long_name ELSE short_name END AS short_name, CASE WHEN route_id % 4 = 0 THEN 3 ELSE route_type END AS route_type FROM v_routes")
def gtfs_routes(spark: SparkSession, sf: str) -> DataFrame:
    r = feed.routes(spark, sf).withColumn("short", F.when(F.col("route_id") % 3 != 0, F.col("short_name"))).withColumn("type", F.when(F.col("route_id") % 4 != 0, F.col("route_type")))
    got = gtfs.routes(gtfs.parse_lines(_csv(r, "route_id", "short", "long_name", "type"), ["route_id", "route_short_name", "route_long_name", "route_type"], ["route_id", "route_short_name", "route_long_name", "route_type"]))
    return got.select("route_id", "short_name", "route_type")


@query("SRC-07_08_gtfs_calendar", "SELECT service_id, CAST(day AS VARCHAR) AS day FROM v_service_days")
def gtfs_calendar(spark: SparkSession, sf: str) -> DataFrame:
    days = feed.service_days(spark, sf)
    lines = _csv(days.withColumn("date", F.date_format("day", "yyyyMMdd")).withColumn("t", F.lit("1")), "service_id", "date", "t")
    rows = gtfs.parse_lines(lines, ["service_id", "date", "exception_type"], ["service_id", "date", "exception_type"])
    none = gtfs.calendar(spark.createDataFrame([], ", ".join(f"{c} string" for c in ("service_id", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday", "start_date", "end_date"))))
    got = timetable.calendar_expand(none, gtfs.calendar_dates(rows, F.lit(0)).withColumn("n", F.lit(0)))
    return got.select("service_id", F.col("day").cast("string").alias("day"))


@query("SRC-09_10_gtfs_stop_times", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, seq, CAST(stop_id AS VARCHAR) AS stop_id, dep, CASE WHEN pos % 3 = 0 THEN dep ELSE arr END AS arr FROM v_stop_times")
def gtfs_stop_times(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stop_times(spark, sf).withColumn("d", times.clock(F.col("dep"))).withColumn("a", F.when(F.col("pos") % 3 != 0, times.clock(F.col("arr"))))
    names = ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"]
    rows = gtfs.parse_lines(_csv(s, "trip_id", "stop_id", "seq", "a", "d"), names, names)
    trips = feed.trips(spark, sf).select(F.col("trip_id").cast("string").alias("trip_id"))
    stops = feed.stops(spark, sf).select(F.col("stop_id").cast("string").alias("stop_id"))
    return gtfs.stop_times(rows, trips, stops)


@query("SRC-11_gtfs_shapes", "SELECT CAST(pattern_id AS VARCHAR) AS shape_id, count(*) AS points, round(sum(lat), 5) AS lat FROM v_pattern_stops JOIN v_stops USING (stop_id) GROUP BY pattern_id")
def gtfs_shapes(spark: SparkSession, sf: str) -> DataFrame:
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id")
    names = ["shape_id", "shape_pt_lat", "shape_pt_lon", "shape_pt_sequence"]
    rows = gtfs.parse_lines(_csv(at, "pattern_id", "lat", "lon", "pos"), names, names)
    got = gtfs.shapes(rows, rows.select("shape_id"))
    return got.select("shape_id", F.size("points").cast("bigint").alias("points"), F.round(F.aggregate("points", feed.d(0), lambda a, p: a + p["lat"]), 5).alias("lat"))


@query("SRC-12_13_14_realtime_vehicles", "SELECT CAST(event_id AS VARCHAR) AS id, CAST(vehicle AS VARCHAR) AS trip_id, round(CAST(CAST(lat AS REAL) AS DOUBLE), 5) AS lat, round(CAST(CAST(lon AS REAL) AS DOUBLE), 5) AS lon, CAST(1700000000 + event_id AS BIGINT) AS ts FROM v_fixes")
def realtime_vehicles(spark: SparkSession, sf: str) -> DataFrame:
    rows = feed.fixes(spark, sf).select("event_id", "vehicle", "lat", "lon")
    sent = gtfs_rt.payloads(rows, lambda r: gtfs_rt.vehicle_message(str(r.event_id), str(r.vehicle), r.lat, r.lon, 1700000000 + r.event_id))
    return gtfs_rt.vehicles(sent).select("id", "trip_id", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "ts")


@query("SRC-15_realtime_updates", "SELECT CAST(trip_id AS VARCHAR) AS trip_id, canceled, pos AS seq, delay, skipped FROM v_updates")
def realtime_updates(spark: SparkSession, sf: str) -> DataFrame:
    sent = gtfs_rt.payloads(feed.updates(spark, sf), lambda r: gtfs_rt.update_message(str(r.event_id), str(r.trip_id), r.pos, r.delay, r.skipped, r.canceled))
    return gtfs_rt.trip_updates(sent).select("trip_id", "canceled", "seq", "delay", "skipped")


@query(
    "SRC-16_SCL-11_realtime_alerts",
    """SELECT CAST(id AS VARCHAR) AS id, CASE WHEN id % 3 = 0 THEN 'Notice' ELSE header END AS header, CAST(cause AS INT) AS cause, CAST(effect AS INT) AS effect,
    array_to_string(list_sort(list_distinct([CAST(route_id AS VARCHAR), CAST((route_id + id) % 25 AS VARCHAR)])), ',') AS routes, CAST(stop_id AS VARCHAR) AS stops,
    CAST(epoch(start) AS BIGINT) AS since, coalesce(CAST(epoch("end") AS BIGINT), -1) AS until, 2::INT AS periods FROM v_alerts""",
)
def realtime_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Alerts written to the wire with two languages, two routes and two periods, and read back."""
    a = feed.alerts(spark, sf).select("id", "header", "cause", "effect", "route_id", "stop_id", F.unix_seconds(F.col("start").cast("timestamp")).alias("since"), F.coalesce(F.unix_seconds(F.col("end").cast("timestamp")), F.lit(0)).alias("until"))

    def message(r) -> bytes:
        texts = [("Notice", "en")] + ([(r.header, "IT")] if r.id % 3 else [])
        routes = [str(r.route_id), str((r.route_id + r.id) % 25), str(r.route_id)]
        return gtfs_rt.alert_message(str(r.id), texts, r.cause, r.effect, routes, [str(r.stop_id)], [], [(r.since, r.until or None), (None, 5)])

    got = gtfs_rt.alerts(gtfs_rt.payloads(a, message))
    first = F.get("periods", F.lit(0))
    return got.select("id", text.translation(F.col("headers")).alias("header"), "cause", "effect", F.array_join("route_ids", ",").alias("routes"), F.array_join("stop_ids", ",").alias("stops"), first["start"].alias("since"), F.coalesce(first["end"], F.lit(-1)).alias("until"), F.size("periods").alias("periods"))


@query("SRC-18_19_28_osm_json", "SELECT pattern_id AS way_id, 'bus' AS kind, count(*) AS points FROM v_pattern_stops GROUP BY pattern_id")
def osm_json(spark: SparkSession, sf: str) -> DataFrame:
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id").groupBy("pattern_id").agg(F.collect_list(F.struct("lat", "lon")).alias("geometry"))
    way = F.struct(F.lit("way").alias("type"), F.col("pattern_id").alias("id"), F.create_map(F.lit("route"), F.lit("bus")).alias("tags"), "geometry")
    bodies = at.select(F.to_json(F.struct(F.array(way, way).alias("elements"))).alias("body"))
    return osm.ways(bodies).select(F.col("way_id").cast("int").alias("way_id"), F.col("tags")["route"].alias("kind"), F.size("points").cast("bigint").alias("points"))


@query("SRC-20_21_SCL-09_osm_opl", "SELECT pattern_id AS way_id, 'à, b' AS name, count(*) AS points FROM v_pattern_stops GROUP BY pattern_id")
def osm_opl(spark: SparkSession, sf: str) -> DataFrame:
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id").groupBy("pattern_id").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id", "lat", "lon"))).alias("p"))
    nodes = F.array_join(F.transform("p", lambda x: F.concat(F.lit("n"), x["stop_id"], F.format_string("x%.7fy%.7f", x["lon"], x["lat"]))), ",")
    good = F.concat(F.lit("w"), "pattern_id", F.lit(" v1 T"), F.lit("name=%e0%%2c%%20%b,highway=busway"), F.lit(" N"), nodes)
    broken = F.concat(F.lit("w9"), "pattern_id", F.lit(" v1 Tname=x Nn1,n2"))
    lines = at.select(F.explode(F.array(good, broken, F.lit("n1 v1 x7 y45"))).alias("line"))
    return osm.opl_ways(lines).select(F.col("way_id").cast("int").alias("way_id"), F.col("tags")["name"].alias("name"), F.size("points").cast("bigint").alias("points"))


@query("SRC-22_osm_tiles", "SELECT CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT min(floor(lat / 0.1::DOUBLE)) AS a, max(floor(lat / 0.1::DOUBLE)) AS b, min(floor(lon / 0.1::DOUBLE)) AS c, max(floor(lon / 0.1::DOUBLE)) AS d FROM v_stops), LATERAL (SELECT unnest(range(CAST(a AS INT), CAST(b AS INT) + 1)) AS y), LATERAL (SELECT unnest(range(CAST(c AS INT), CAST(d AS INT) + 1)) AS x)")
def osm_tiles(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda f, c: f(F.floor(F.col(c) / feed.d(0.1)).cast("int"))
    box = feed.stops(spark, sf).agg(cell(F.min, "lat").alias("a"), cell(F.max, "lat").alias("b"), cell(F.min, "lon").alias("c"), cell(F.max, "lon").alias("d"))
    return box.select(F.explode(F.sequence("a", "b")).alias("y"), "c", "d").select("y", F.explode(F.sequence("c", "d")).alias("x"))


@query("SRC-24_31_32_33_json_sources", "SELECT event_id, value AS amount, event_type AS kind, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events")
def json_sources(spark: SparkSession, sf: str) -> DataFrame:
    body = F.to_json(F.struct(F.col("value").alias("amount"), F.struct(F.col("event_type").alias("kind")).alias("properties"), F.col("props")))
    e = table(spark, sf, "events").select("event_id", F.from_json(body, "amount double, properties struct<kind:string>, props string").alias("x"))
    return e.select("event_id", "x.amount", "x.properties.kind", F.from_json("x.props", "k int")["k"].alias("k"))


# -- sinks ----------------------------------------------------------------------------------------------------------


@query(
    "SNK-01_11_manifest",
    "SELECT count(*) AS rows, sum(stop_id) AS ids, CAST(coalesce(sum(CAST('0x' || substr(md5(to_json({'name': name, 'stop_id': stop_id})), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS digest FROM v_stops",
)
def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Row count, a sum and the digest of the rows in any order: partial sums, no task holds the table."""
    s = feed.stops(spark, sf)
    return s.agg(F.sum("stop_id").alias("ids")).crossJoin(artefacts.digest(s.select("stop_id", "name")))  # one row each


@query("SNK-06_features", "SELECT stop_id, round(lon, 6) AS lon, round(lat, 6) AS lat, bool_or(route_type = 1) AS metro, bool_or(route_type = 0) AS tram FROM v_stops JOIN v_pattern_stops USING (stop_id) JOIN v_routes USING (route_id) GROUP BY ALL")
def features(spark: SparkSession, sf: str) -> DataFrame:
    t = feed.pattern_stops(spark, sf).join(feed.routes(spark, sf), "route_id").groupBy("stop_id").agg(F.bool_or(F.col("route_type") == 1).alias("metro"), F.bool_or(F.col("route_type") == 0).alias("tram"))
    f = feed.stops(spark, sf).join(t, "stop_id").select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates")).alias("geometry"), F.struct("stop_id", "metro", "tram").alias("properties"))).alias("j"))
    x = F.from_json("j", "geometry struct<coordinates:array<double>>, properties struct<stop_id:bigint,metro:boolean,tram:boolean>")
    return f.select(x.alias("x")).select("x.properties.stop_id", F.get("x.geometry.coordinates", 0).alias("lon"), F.get("x.geometry.coordinates", 1).alias("lat"), "x.properties.metro", "x.properties.tram")


@query("SNK-07_vehicle_features", "SELECT event_id, r.short_name AS line, CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 7 THEN 'funicular' ELSE 'bus' END AS mode FROM v_fixes f LEFT JOIN v_routes r ON f.k % 30 = r.route_id")
def vehicle_features(spark: SparkSession, sf: str) -> DataFrame:
    r = feed.routes(spark, sf).select("route_id", "short_name", "route_type")
    return feed.fixes(spark, sf).join(r, F.col("k") % 30 == F.col("route_id"), "left").select("event_id", F.col("short_name").alias("line"), text.mode_key(F.col("route_type")).alias("mode"))


@query(
    "SNK-09_me_feature",
    """SELECT event_id, round(lon, 6) AS lon, round(lat, 6) AS lat, round(least(value * 20, 2000) * 4194304 / (78271.51696402048::DOUBLE * cos(radians(lat))), 3) AS r22,
    CAST(coalesce(CASE WHEN event_id % 9 >= 4 THEN event_id % 360 WHEN event_id % 3 <> 0 THEN (event_id + 90) % 360 END, -1) AS INT) AS heading FROM v_fixes WHERE event_id % 11 <> 0""",
)
def me_feature(spark: SparkSession, sf: str) -> DataFrame:
    """The rider's point with its accuracy's radius at zoom 22 and the beam's heading, -1 without one; no fix, no feature."""
    e = F.col("event_id")
    heading = F.coalesce(geo.me_heading(e % 9, e % 360, F.when(e % 3 != 0, (e + 90) % 360), at_rest=False), F.lit(-1)).cast("int")
    r22 = F.least(F.col("value") * 20, feed.d(2000)) * feed.d(1 << 22) / (feed.d(78271.51696402048) * F.cos(F.radians("lat")))
    point = F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(r3(r22).alias("r22"), heading.alias("heading")).alias("properties")))
    rows = feed.fixes(spark, sf).where(e % 11 != 0).select("event_id", F.from_json(feature, "geometry struct<coordinates:array<double>>, properties struct<r22:double,heading:int>").alias("x"))
    return rows.select("event_id", F.get("x.geometry.coordinates", 0).alias("lon"), F.get("x.geometry.coordinates", 1).alias("lat"), "x.properties.r22", "x.properties.heading")


@query("SNK-12_widget_payload")
def widget_payload(spark: SparkSession, sf: str) -> DataFrame:
    top = timetable.first_n(board(spark, sf), ["stop_id"], 12, "expected", "trip_id", "pos")
    return top.groupBy("stop_id").agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("rank", "trip_id", "expected"))), lambda x: F.struct(x["trip_id"].alias("trip_id"), x["expected"].alias("expected")))).alias("payload"))


@query("SNK-14_15_bounded_logs", "SELECT rider, event_id FROM (SELECT user_id AS rider, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 10")
def bounded_logs(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return table(spark, sf, "events").withColumn("k", F.row_number().over(w)).where("k <= 10").select(F.col("user_id").alias("rider"), "event_id")


@query("SNK-16_17_report_tail", r"SELECT doc_id, md5(right(regexp_replace(text, '-?\d{1,3}\.\d{3,},-?\d{1,3}\.\d{3,}', '…', 'g'), 5000)) AS tail FROM documents")
def report_tail(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(F.right(text.without_positions(F.col("text")), F.lit(5000))).alias("tail"))


@query("SNK-10_entrances", "SELECT event_id FROM v_fixes WHERE kind = 'view' AND k % 4 = 1")
def entrances(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).where("kind = 'view' and k % 4 = 1").select("event_id")
