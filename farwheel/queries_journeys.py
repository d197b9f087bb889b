"""Queries over graphs and journeys (GRF) and live state (STR)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.feed import DAY, NOW, table
from farwheel.functions import geo, times
from farwheel.operators import graph, spatial, timetable
from farwheel.plans import planner
from farwheel.queries_groups import _CLUSTERS
from farwheel.queries_rows import _GONE, _PAIRS, DELAYS
from farwheel.queries_scalars import HAVERSINE, r3
from farwheel.registry import query
from farwheel.streaming import live, ride


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request a customer nation: from one stop's place to another's, departures five minutes apart."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("request"))
    stops = feed.stops(spark, sf)
    total = stops.agg(F.count("*").alias("n"))
    a = stops.select(F.col("stop_id").alias("a"), "lat", "lon")
    b = stops.select(F.col("stop_id").alias("b"), F.col("lat").alias("to_lat"), F.col("lon").alias("to_lon"))
    n = n.crossJoin(F.broadcast(total)).withColumn("a", (F.col("request") * 7) % F.col("n")).withColumn("b", (F.col("request") * 7 + 4) % F.col("n"))
    return n.join(a, "a").join(b, "b").select("request", "lat", "lon", "to_lat", "to_lon", (F.lit(NOW) + F.col("request") * 300).cast("int").alias("depart"))


def plan(spark: SparkSession, sf: str, max_transfers: int = 1, suspended: DataFrame | None = None) -> DataFrame:
    return planner.plan(requests(spark, sf), feed.stops(spark, sf), feed.pattern_stops(spark, sf), feed.stop_times(spark, sf), feed.service_days(spark, sf), DAY, max_transfers=max_transfers, suspended=suspended)


_WALK = "CAST(round({} * 1.35::DOUBLE / 1.2::DOUBLE) AS INT)"
#: Direct rides in SQL: seeds, earliest run of each (pattern, position), alighting, egress, skyline.
_DIRECT = f"""
    q AS (SELECT n_nationkey AS request, a.lat, a.lon, b.lat AS tlat, b.lon AS tlon, {NOW} + n_nationkey * 300 AS depart FROM nation
      JOIN v_stops a ON a.stop_id = (n_nationkey * 7) % (SELECT count(*) FROM supplier) JOIN v_stops b ON b.stop_id = (n_nationkey * 7 + 4) % (SELECT count(*) FROM supplier)),
    s AS (SELECT request, stop_id, m AS walk, depart + {_WALK.format('m')} AS t FROM (SELECT request, depart, stop_id, {HAVERSINE.format('q.lat', 'q.lon', 's.lat', 's.lon')} AS m FROM q, v_stops s) WHERE m <= 400),
    e AS (SELECT request, stop_id, m AS egress FROM (SELECT request, stop_id, {HAVERSINE.format('q.tlat', 'q.tlon', 's.lat', 's.lon')} AS m FROM q, v_stops s) WHERE m <= 400),
    r AS (SELECT s.trip_id, s.pattern_id, s.pos, s.dep + o * 86400 AS dep, o * 86400 AS shift FROM v_stop_times s, (SELECT unnest([0, -1, 1]) AS o) WHERE EXISTS (SELECT 1 FROM v_service_days d WHERE d.service_id = s.service_id AND d.day = DATE '{DAY}' + o)),
    b AS (SELECT s.request, s.walk, s.t, p.pattern_id, p.pos, min((r.dep, r.trip_id, r.shift)) AS run FROM s JOIN v_pattern_stops p ON s.stop_id = p.stop_id AND NOT p.is_last JOIN r ON r.pattern_id = p.pattern_id AND r.pos = p.pos AND r.dep >= s.t GROUP BY ALL),
    f AS (SELECT b.request, x.arr + b.run[3] + {_WALK.format('e.egress')} AS arr, round(b.walk + e.egress, 3) AS walk FROM b JOIN v_stop_times x ON x.trip_id = b.run[2] AND x.pos > b.pos JOIN e ON e.request = b.request AND e.stop_id = x.stop_id WHERE b.walk + e.egress <= 1000),
    k AS (SELECT DISTINCT request, arr, walk FROM f),
    y AS (SELECT *, min(arr) OVER (PARTITION BY request ORDER BY walk, arr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k)"""


@query(
    "GRF-01_02_plan_direct",
    "WITH " + _DIRECT.strip().replace("min((r.dep, r.trip_id, r.shift)) AS run", "min(row(r.dep, r.trip_id, r.shift)) AS run")
    + " SELECT request, CAST(arr AS INT) AS arr, walk FROM (SELECT *, min(arr) OVER (PARTITION BY request) AS best FROM y WHERE before IS NULL OR arr < before) WHERE arr <= best + 3600",
)
def plan_direct(spark: SparkSession, sf: str) -> DataFrame:
    return plan(spark, sf, 0).select("request", "arr", r3("walk").alias("walk"))


@query("GRF-01_02_04_plan")
def plan_transfers(spark: SparkSession, sf: str) -> DataFrame:
    p = plan(spark, sf, 2)
    return p.select("request", "arr", r3("walk").alias("walk"), "rides", F.size("legs").alias("n_legs"), F.to_json("legs").alias("legs"))


def network(spark: SparkSession, sf: str) -> planner.Network:
    return planner.network(feed.stops(spark, sf), feed.pattern_stops(spark, sf), feed.stop_times(spark, sf), feed.service_days(spark, sf), DAY)


@query("GRF-03_TOP-19_arrive_by")
def arrive_by(spark: SparkSession, sf: str) -> DataFrame:
    """Every request's latest departures that arrive within an hour of asking, on direct rides."""
    asks = requests(spark, sf).withColumn("deadline", F.col("depart") + 3600).drop("depart")
    found = planner.arrive_by(asks, network(spark, sf), max_transfers=0)
    return found.select("request", "departure", "arr", r3("walk").alias("walk"), "rides")


@query("GRF-05_06_reprice_walks")
def reprice_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Journeys with walks routed over footpaths of 200 m, boarded anew where a walk misses its ride."""
    from farwheel.operators import paths

    net = network(spark, sf)
    journeys = graph.cut(planner.search(requests(spark, sf), net, 1))
    walked = journeys.select(F.explode("legs").alias("x")).where("x.kind = 'walk' and x.from_stop <> x.to_stop")  # no other walk has a route
    routed = paths.within_cost(walk_graph(spark, sf), walked.select(F.col("x.from_stop").alias("source")).distinct(), 600.0)
    found = planner.reprice(journeys, net, routed.select(F.col("source").alias("from_stop"), F.col("node").alias("to_stop"), "metres"), cap=1350.0)
    return found.select("request", "departure", "arr", r3("walk").alias("walk"), "rides")


@query("GRF-07_footpath_table", f"SELECT a AS from_stop, b AS to_stop, round(m, 3) AS metres, CAST(row_number() OVER (PARTITION BY a ORDER BY round(m, 6), b) AS INT) AS rank FROM ({_PAIRS}) WHERE a <> b AND m <= 400")
def footpath_table(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("from_stop").orderBy(F.round("metres", 6), "to_stop")
    return spatial.footpaths(feed.stops(spark, sf)).withColumn("rank", F.row_number().over(w)).withColumn("metres", r3("metres"))


@query(
    "GRF-08_road_graph",
    """SELECT s.pattern_id AS way_id, round(a.lat, 6) AS from_lat, round(a.lon, 6) AS from_lon, round(b.lat, 6) AS to_lat, round(b.lon, 6) AS to_lon FROM v_pattern_stops s JOIN v_pattern_stops n ON s.pattern_id = n.pattern_id AND (n.pos = s.pos + 1 OR (n.pos = s.pos - 1 AND s.pattern_id % 2 = 0))
    JOIN v_stops a ON s.stop_id = a.stop_id JOIN v_stops b ON n.stop_id = b.stop_id WHERE s.stop_id <> n.stop_id""",
)
def road_graph(spark: SparkSession, sf: str) -> DataFrame:
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf).select("stop_id", "lat", "lon"), "stop_id")
    points = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))
    ways = at.groupBy(F.col("pattern_id").alias("way_id")).agg(points.alias("points")).withColumn("oneway", F.col("way_id") % 2 == 1)
    return graph.road_edges(ways).select("way_id", *(F.round(c, 6).alias(c) for c in ("from_lat", "from_lon", "to_lat", "to_lon")))


@query(
    "GRF-10_canonicalise",
    f"""WITH n AS (SELECT stop_id, CAST(round(lat * 100000) AS INT) AS y, CAST(round(lon * 100000) AS INT) AS x FROM v_stops), k AS (SELECT y, x, row_number() OVER (ORDER BY y, x) - 1 AS node FROM (SELECT DISTINCT y, x FROM n)), o AS (SELECT stop_id, node FROM n JOIN k USING (y, x)),
    e AS (SELECT DISTINCT least(p.node, q.node) AS a, greatest(p.node, q.node) AS b, CAST((least(p.node, q.node) + greatest(p.node, q.node)) % 3 AS INT) AS flags FROM ({_PAIRS}) w JOIN o p ON w.a = p.stop_id JOIN o q ON w.b = q.stop_id WHERE w.a <> w.b AND m <= 200)
    SELECT row_number() OVER (ORDER BY a, b, flags) - 1 AS edge, a, b, flags FROM e""",
)
def canonicalise(spark: SparkSession, sf: str) -> DataFrame:
    """The walking graph of footpaths in canonical form; flags are made of an edge's ends."""
    stops = feed.stops(spark, sf)
    nodes = stops.select(F.col("stop_id").alias("key"), geo.fixed(F.col("lat"), 100_000).alias("lat_e5"), geo.fixed(F.col("lon"), 100_000).alias("lon_e5"))
    found = graph.canonical(nodes, walk_graph(spark, sf).select("a", "b", F.lit(0).alias("flags"), F.lit("").alias("name")))[1]
    return found.select("edge", "a", "b", ((F.col("a") + F.col("b")) % 3).cast("int").alias("flags"))


@query("GRF-11_connected_components", _CLUSTERS + " SELECT s AS node, min(o) AS component FROM c GROUP BY s")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    stops = feed.stops(spark, sf)
    return graph.components(stops.select(F.col("stop_id").alias("node")), spatial.same_name_pairs(stops, 450))


def walk_graph(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, metres): footpaths of 200 m as a walking graph."""
    p = spatial.footpaths(feed.stops(spark, sf), 200)
    return p.select(F.col("from_stop").alias("a"), F.col("to_stop").alias("b"), F.round("metres", 3).alias("metres"))


@query(
    "GRF-12_13_shortest_walks",
    f"""WITH RECURSIVE e AS (SELECT a, b, round(m, 3) AS m FROM ({_PAIRS}) WHERE a <> b AND m <= 200),
    d(s, t, m) AS (SELECT stop_id, stop_id, 0.0::DOUBLE FROM v_stops UNION SELECT d.s, e.b, round(d.m + e.m, 3) FROM d JOIN e ON d.t = e.a WHERE d.m + e.m <= 500)
    SELECT s AS source, t AS node, round(min(m), 2) AS metres FROM d GROUP BY ALL""",
)
def shortest_walks(spark: SparkSession, sf: str) -> DataFrame:
    from farwheel.operators import paths

    sources = feed.stops(spark, sf).select(F.col("stop_id").alias("source"))
    return paths.within_cost(walk_graph(spark, sf), sources, 500.0).select("source", "node", F.round("metres", 2).alias("metres"))


@query("GRF-16_hmm_match")
def hmm_match(spark: SparkSession, sf: str) -> DataFrame:
    from farwheel.operators import edges, matching

    segments = edges.pattern_segments(feed.pattern_stops(spark, sf), feed.stops(spark, sf), 45.0, 7.6)
    x, y = geo.plane(F.col("lat"), F.col("lon"), 45.0, 7.6)
    points = feed.fixes(spark, sf).select("vehicle", "ts", "event_id", x.alias("px"), y.alias("py"))
    return matching.viterbi(points, segments, radius=150.0, most=8)


@query("GRF-22_chord", "SELECT pattern_id, string_agg(printf('%.6f,%.6f', lon, lat), ';' ORDER BY pos) AS line FROM v_pattern_stops JOIN v_stops USING (stop_id) GROUP BY pattern_id")
def chord(spark: SparkSession, sf: str) -> DataFrame:
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id")
    line = F.transform(F.sort_array(F.collect_list(F.struct("pos", "lon", "lat"))), lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"]))
    return at.groupBy("pattern_id").agg(F.array_join(line, ";").alias("line"))


@query("GRF-23_merge_chain")
def merge_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Maximal chains of segments with one mode and route set: a node of degree two joins its two segments."""
    w = Window.partitionBy("pattern_id").orderBy("pos")
    hops = feed.pattern_stops(spark, sf).withColumn("to_node", F.lead("stop_id").over(w)).where("to_node is not null and to_node <> stop_id").join(feed.routes(spark, sf).select("route_id", "route_type"), "route_id")
    m = graph.merge_segments(hops.select(F.col("route_type").alias("mode"), F.col("stop_id").alias("from_node"), "to_node", F.col("route_id").cast("string").alias("route")))
    seg = m.withColumn("id", F.xxhash64("mode", "a", "b")).withColumn("key", F.concat_ws("|", "mode", F.array_join("routes", ","), "directions"))
    ends = seg.select("id", "key", F.explode(F.array("a", "b")).alias("node"))
    through = ends.groupBy("key", "node").agg(F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y")).where("n = 2")
    found = graph.components(seg.select(F.col("id").alias("node")), through.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return seg.join(found, seg["id"] == found["node"]).groupBy("component").agg(F.first("key").alias("key"), F.count("*").alias("segments"), F.min("a").alias("least_node")).select("key", "segments", "least_node")


@query("GRF-26_discover_hops")
def discover_hops(spark: SparkSession, sf: str) -> DataFrame:
    """Requests for which a ride saves most walking against the straight walk, twenty at most."""
    best = plan(spark, sf, 1).groupBy("request").agg(F.min("walk").alias("walk"))
    both = best.join(planner.direct_walk(requests(spark, sf)), "request").withColumn("saved", r3(F.col("metres") - F.col("walk")))
    return both.where("saved >= 100").orderBy(F.col("saved").desc(), "request").limit(20).select("request", "saved")


@query(
    "GRF_position_jumps",
    f"""SELECT event_id FROM (SELECT event_id, {HAVERSINE.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS m FROM v_fixes WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)) WHERE m > 1500""",
)
def position_jumps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("vehicle").orderBy("ts", "event_id")
    m = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    return feed.fixes(spark, sf).withColumn("m", m).where("m > 1500").select("event_id")


# -- streaming and state --------------------------------------------------------------------------------------------


@query("STR-02_latest_by_key", "SELECT vehicle, arg_max(event_id, (ts, event_id)) AS event_id FROM v_fixes GROUP BY vehicle")
def latest_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return live.latest(feed.fixes(spark, sf), ["vehicle"], ["ts", "event_id"]).select("vehicle", "event_id")


@query("STR-03_expiry", "SELECT vehicle FROM v_fixes GROUP BY vehicle HAVING max(ts) >= (SELECT max(ts) FROM v_fixes) - INTERVAL 30 MINUTE")
def expiry(spark: SparkSession, sf: str) -> DataFrame:
    f = feed.fixes(spark, sf)
    newest = f.agg((F.max("ts") - F.expr("INTERVAL 30 MINUTES")).alias("since"))
    return f.groupBy("vehicle").agg(F.max("ts").alias("ts")).crossJoin(F.broadcast(newest)).where("ts >= since").select("vehicle")


@query(
    "STR-05_delay_lookup",
    """SELECT trip_id, pos, dep + delay AS expected FROM (SELECT s.trip_id, s.pos, s.dep, last_value(u.delay IGNORE NULLS) OVER (PARTITION BY s.trip_id ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS delay
    FROM v_stop_times s LEFT JOIN (SELECT trip_id, pos, arg_max(delay, event_id) AS delay FROM v_updates GROUP BY trip_id, pos) u ON s.trip_id = u.trip_id AND s.pos = u.pos) WHERE delay IS NOT NULL""",
)
def delay_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """When each stop of a run with updates is expected, in one window: the delay of the last update at or before it."""
    return timetable.delay_asof(feed.stop_times(spark, sf), feed.updates(spark, sf), keep=["dep"]).select("trip_id", "pos", (F.col("dep") + F.col("delay")).alias("expected"))


@query("STR-06_unavailable_lookup", _GONE)
def unavailable_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.unavailable(feed.stop_times(spark, sf), feed.updates(spark, sf))


@query("STR_track_progress")
def live_advance(spark: SparkSession, sf: str) -> DataFrame:
    return live.replay(feed.fixes(spark, sf).select(F.col("vehicle").alias("trip_key"), "ts", "lat", "lon", "event_id"))


_EVENTS = """SELECT vehicle AS trip_key, event_id, CAST(((epoch_us(ts) // 3600000000) - min(epoch_us(ts) // 3600000000) OVER (PARTITION BY vehicle)) AS DOUBLE) AS t, CASE kind WHEN 'error' THEN 'next' WHEN 'view' THEN 'tick' ELSE 'fix' END AS what, value AS along FROM v_fixes"""


@query(
    "STR-09_10_15_ride_progress",
    f"""WITH x AS ({_EVENTS}), n AS (SELECT *, sum(CASE WHEN what = 'next' THEN 1 ELSE 0 END) OVER w AS leg, max(CASE WHEN what = 'fix' THEN t END) OVER w AS last_fix FROM x WINDOW w AS (PARTITION BY trip_key ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, what = 'tick' AND coalesce(t - last_fix >= 20, false) AS stale, leg % 2 = 0 AS ride FROM n WHERE leg < 6),
    m AS (SELECT *, coalesce(max(CASE WHEN what = 'fix' THEN least(along, 400) WHEN stale AND ride THEN 400 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (t - (leg * 200 + 30)) / 180)) END) OVER (PARTITION BY trip_key, leg ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 0.0::DOUBLE) AS place FROM s),
    c AS (SELECT *, CAST(CASE WHEN place < 100 THEN 4 WHEN place < 200 THEN 3 WHEN place < 300 THEN 2 WHEN place < 400 THEN 1 ELSE 0 END AS INT) AS stops_left FROM m),
    b AS (SELECT *, coalesce(lag(stops_left) OVER (PARTITION BY trip_key, leg ORDER BY t, event_id), 4) AS before FROM c)
    SELECT trip_key, event_id, CAST(leg AS BIGINT) AS leg, round(place, 6) AS along, stops_left, stale AS estimated, CASE WHEN NOT ride THEN NULL WHEN stops_left = 0 AND before > 0 THEN 'alight_now' WHEN stops_left = 1 AND before > 1 THEN 'one_stop_left' END AS cue FROM b""",
)
def ride_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Errors end a leg, views are ticks, other events fixes; six legs of 400 m and four stops, every second one a ride 30 s late."""
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000)
    what = F.when(F.col("kind") == "error", "next").when(F.col("kind") == "view", "tick").otherwise("fix")
    f = feed.fixes(spark, sf).withColumn("hour", hour)
    first = F.min("hour").over(Window.partitionBy("vehicle"))
    events = f.select(F.col("vehicle").alias("trip_key"), "event_id", (F.col("hour") - first).cast("double").alias("t"), what.alias("what"), F.col("value").alias("along"))
    leg = spark.range(6).select(F.col("id").alias("leg"), (F.col("id") % 2 == 0).alias("ride"), F.lit(400.0).alias("metres"), (F.col("id") * 200.0).alias("departure"), (F.col("id") * 200.0 + 180.0).alias("arrival"), F.lit(30.0).alias("delay"), F.array(*map(F.lit, (100.0, 200.0, 300.0, 400.0))).alias("stops"))
    legs = events.select("trip_key").distinct().crossJoin(leg)  # six rows a trip
    return ride.progress(events, legs).select("trip_key", "event_id", "leg", F.round("along", 6).alias("along"), "stops_left", F.coalesce("estimated", F.lit(False)).alias("estimated"), "cue")


@query(
    "STR-12_missed_ride",
    f"SELECT trip_id FROM v_trips t LEFT JOIN (SELECT trip_id, min(delay) AS delay FROM v_updates GROUP BY trip_id) u USING (trip_id) WHERE {NOW} > base + coalesce(delay, 0) + 90 AND base > {NOW} - 3600",
)
def missed_ride(spark: SparkSession, sf: str) -> DataFrame:
    u = feed.updates(spark, sf).groupBy("trip_id").agg(F.min("delay").alias("delay"))
    late = F.lit(NOW) > F.col("base") + F.coalesce("delay", F.lit(0)) + 90
    return feed.trips(spark, sf).where(F.col("base") > NOW - 3600).join(u, "trip_id", "left").where(late).select("trip_id")


@query(
    "STR-13_connection_risk",
    "SELECT a.trip_id, a.arr + coalesce(d.delay, 0) + 300 > n.dep AS risk FROM v_stop_times a LEFT JOIN (SELECT trip_id, arg_max(delay, event_id) AS delay FROM v_updates GROUP BY trip_id) d ON a.trip_id = d.trip_id JOIN v_stop_times n ON n.trip_id = a.trip_id + 1 AND n.pos = 4 WHERE a.pos = 3",
)
def connection_risk(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stop_times(spark, sf)
    d = feed.updates(spark, sf).groupBy("trip_id").agg(F.max_by("delay", "event_id").alias("delay"))
    n = s.where("pos = 4").select((F.col("trip_id") - 1).alias("trip_id"), F.col("dep").alias("next"))
    both = s.where("pos = 3").join(d, "trip_id", "left").join(n, "trip_id")
    return both.select("trip_id", (F.col("arr") + F.coalesce("delay", F.lit(0)) + 300 > F.col("next")).alias("risk"))


@query("STR-16_trip_summary", f"SELECT vehicle, count(*) AS fixes, round(min(lat), 6) AS south, round(max(lat), 6) AS north FROM v_fixes GROUP BY vehicle")
def trip_summary(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).groupBy("vehicle").agg(F.count("*").alias("fixes"), F.round(F.min("lat"), 6).alias("south"), F.round(F.max("lat"), 6).alias("north"))


@query(
    "STR-18_change_detection",
    "SELECT event_id FROM (SELECT event_id, kind, lag(kind) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS was FROM v_fixes) WHERE was IS DISTINCT FROM kind",
)
def change_detection(spark: SparkSession, sf: str) -> DataFrame:
    return live.changes(feed.fixes(spark, sf), ["vehicle"], ["ts", "event_id"], "kind").select("event_id")


@query("STR-19_heading_filter")
def heading_filter(spark: SparkSession, sf: str) -> DataFrame:
    f = feed.fixes(spark, sf).select("vehicle", "ts", "event_id", (F.col("k") * 3.6).alias("heading"))
    return live.smooth_headings(f)
