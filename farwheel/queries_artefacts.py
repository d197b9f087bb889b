"""Queries over artefacts, drawn features and caches: written, read back and checked."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.feed import table
from farwheel.functions import geo
from farwheel.operators import features, graph
from farwheel.queries_groups import _SEGMENTS, route_tiers
from farwheel.queries_journeys import walk_graph
from farwheel.queries_scalars import HAVERSINE, r3
from farwheel.registry import ORACLE_SQL, query
from farwheel.sources import artefacts
from farwheel.streaming import live


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{graph._scratch(spark)}/farwheel-{kind}-{uuid4().hex}"


@query(
    "SNK-02_SRC-26_lines_artefact",
    "SELECT CAST(pattern_id AS BIGINT) AS line, count(*) AS n, string_agg(CAST(stop_id AS VARCHAR), '-' ORDER BY pos) AS signature FROM v_pattern_stops GROUP BY pattern_id",
)
def lines_artefact(spark: SparkSession, sf: str) -> DataFrame:
    p = feed.pattern_stops(spark, sf).select(F.col("pattern_id").cast("bigint").alias("line"), F.col("pos").alias("i"), "stop_id")
    order = F.transform(F.array_sort(F.collect_list(F.struct("i", "stop_id"))), lambda x: x["stop_id"].cast("string"))
    signatures = p.groupBy("line").agg(F.array_join(order, "-").alias("signature"))
    path = _folder(spark, "lines")
    artefacts.write_lines(p, signatures, path, "1")
    return artefacts.read_lines(spark, path).groupBy("line", "signature").agg(F.count("*").alias("n"))


@query("SNK-03_SRC-27_walkgraph_artefact", "")
def walkgraph_artefact(spark: SparkSession, sf: str) -> DataFrame:
    """The canonical walking graph (GRF-10), written and read back; edges as read."""
    stops = feed.stops(spark, sf)
    nodes = stops.select(F.col("stop_id").alias("key"), geo.fixed(F.col("lat"), 100_000).alias("lat_e5"), geo.fixed(F.col("lon"), 100_000).alias("lon_e5"))
    path = _folder(spark, "walk")
    artefacts.write_walk_graph(*graph.canonical(nodes, walk_graph(spark, sf).select("a", "b", F.lit(0).alias("flags"), F.lit("").alias("name"))), path, "1")
    return artefacts.read_walk_graph(spark, path)[1].select("edge", "a", "b", ((F.col("a") + F.col("b")) % 3).cast("int").alias("flags"))


ORACLE_SQL["SNK-03_SRC-27_walkgraph_artefact"] = ORACLE_SQL["GRF-10_canonicalise"]


@query(
    "SNK-01_SRC-25_index_artefact",
    "SELECT count(*) AS rows, CAST(coalesce(sum(CAST('0x' || substr(md5(to_json({'name': name, 'stop_id': stop_id})), 1, 15) AS BIGINT)), 0) AS VARCHAR) AS digest, 'index' AS kind, 'v1' AS version FROM v_stops",
)
def index_artefact(spark: SparkSession, sf: str) -> DataFrame:
    """The manifest of the stops' table, whose rows are checked against it on reading."""
    path = _folder(spark, "index")
    artefacts.write(feed.stops(spark, sf).select("stop_id", "name"), path, "index", "v1")
    if artefacts.read(spark, path, "index") is None:
        raise ValueError(f"{path}: rows don't fit their manifest")
    return artefacts.manifest(spark, path).select("rows", "digest", "kind", "version")


@query("SNK-13_alert_cache", "SELECT event_type AS feed, max(ts) AS fetched_at, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_id % 7 <> 0 GROUP BY event_type")
def alert_cache(spark: SparkSession, sf: str) -> DataFrame:
    """The last good payload a feed with its time, written and read back; one that doesn't parse never takes a good one's place."""
    e = table(spark, sf, "events").withColumn("payload", F.when(F.col("event_id") % 7 == 0, F.lit("<html>")).otherwise(F.col("props")))
    good = e.where(F.get_json_object("payload", "$.k").isNotNull()).select(F.col("event_type").alias("feed"), F.col("ts").alias("fetched_at"), "event_id", "payload")
    path = _folder(spark, "alerts")
    artefacts.write(live.latest(good, ["feed"], ["fetched_at", "event_id"]).select("feed", "fetched_at", "event_id", "payload"), path, "alerts", "1")
    return artefacts.read(spark, path, "alerts").select("feed", "fetched_at", "event_id")


@query(
    "SNK_drawn_segments",
    f"""WITH tier AS ({{tier}}), h AS (SELECT s.mode, s.f, s.t, r.short_name, tier.tier, {{shade}} AS shade FROM ({_SEGMENTS}) s JOIN v_routes r ON s.route = r.route_id JOIN tier ON s.route = tier.route_id),
    g AS (SELECT mode, least(f, t) AS a, greatest(f, t) AS b, string_agg(DISTINCT short_name, ',' ORDER BY short_name) AS routes, CAST(count(DISTINCT short_name) AS INT) AS n, CAST(min(tier) AS INT) AS tier, CAST(CASE WHEN count(DISTINCT f <= t) = 1 THEN 1 ELSE 0 END AS INT) AS arrow, min(shade) AS shade FROM h GROUP BY ALL)
    SELECT a, b, CASE mode WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 7 THEN 'funicular' ELSE 'bus' END AS mode, routes, n, tier, arrow, CAST(CASE WHEN n = 1 THEN shade ELSE -1 END AS INT) AS shade, round(p.lon, 6) AS lon, round(q.lat, 6) AS lat
    FROM g JOIN v_stops p ON a = p.stop_id JOIN v_stops q ON b = q.stop_id WHERE p.lat <> q.lat OR p.lon <> q.lon""".format(
        tier=ORACLE_SQL["AGG-06_19_route_tiers"][ORACLE_SQL["AGG-06_19_route_tiers"].index("SELECT r.route_id"):],
        shade="CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(r.short_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 2147483647) % 6 AS INT)",
    ),
)
def drawn_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Features of merged segments (not of chains, as SNK-04 has them), read back from their JSON; longitude of one end, latitude of the other."""
    w = Window.partitionBy("pattern_id").orderBy("pos")
    routes = feed.routes(spark, sf).select("route_id", "short_name", "route_type").join(route_tiers(spark, sf), "route_id")
    hops = feed.pattern_stops(spark, sf).withColumn("to_node", F.lead("stop_id").over(w)).where("to_node is not null").join(routes, "route_id")
    hops = hops.select(F.col("route_type").alias("mode"), F.col("stop_id").alias("from_node"), "to_node", F.col("short_name").alias("route"), "tier")
    f = features.segment_features(hops, feed.stops(spark, sf).select(F.col("stop_id").alias("node"), "lat", "lon"))
    x = F.from_json("feature", "geometry struct<coordinates:array<array<double>>>, properties struct<mode:string,routes:string,n:int,tier:int,arrow:int,shade:int>")
    end = lambda i, k: F.get(F.get("x.geometry.coordinates", F.lit(i)), F.lit(k))
    return f.select("a", "b", x.alias("x")).select("a", "b", "x.properties.*", end(0, 0).alias("lon"), end(1, 1).alias("lat"))


_JOURNEY = """j AS (SELECT n_nationkey AS k, n_nationkey % (SELECT count(*) FROM supplier) AS o, (n_nationkey + 5) % (SELECT count(*) FROM supplier) AS d, CAST(n_nationkey * 2 % 50 AS INT) AS pattern, n_nationkey % 4 AS p FROM nation),
    r AS (SELECT k, p, o, d, s.pos - p AS i, s.stop_id, lat, lon FROM j JOIN v_pattern_stops s ON s.pattern_id = pattern AND s.pos BETWEEN p AND p + 3 JOIN v_stops USING (stop_id)),
    x AS (SELECT k, 1 AS leg, 'ride' AS kind, i, lat, lon FROM r UNION ALL SELECT k, 0, 'walk', 0, v.lat, v.lon FROM r JOIN v_stops v ON o = v.stop_id WHERE i = 0 UNION ALL SELECT k, 0, 'walk', 1, lat, lon FROM r WHERE i = 0
      UNION ALL SELECT k, 2, 'walk', 0, lat, lon FROM r WHERE i = 3 UNION ALL SELECT k, 2, 'walk', 1, v.lat, v.lon FROM r JOIN v_stops v ON d = v.stop_id WHERE i = 3)"""


@query(
    "GRF-25_live_route",
    f"""WITH {_JOURNEY}, h AS (SELECT *, {HAVERSINE.format("la", "lo", "lat", "lon")} AS hop FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM x WINDOW w AS (PARTITION BY k, leg ORDER BY i)))
    SELECT k AS trip_key, CAST(leg AS INT) AS leg, kind, count(*) AS n, round(sum(CASE WHEN la IS NULL THEN 0 ELSE hop END), 3) AS metres FROM h WHERE la IS NULL OR hop > 0 GROUP BY ALL""",
)
def live_route(spark: SparkSession, sf: str) -> DataFrame:
    """A journey a nation: a walk to a pattern's stop, a ride of three hops, a walk on."""
    stops, patterns = feed.stops(spark, sf), feed.pattern_stops(spark, sf)
    total = table(spark, sf, "supplier").agg(F.count("*").alias("total"))
    k = F.col("n_nationkey")
    j = table(spark, sf, "nation").crossJoin(total)  # one row
    j = j.select(k.alias("trip_key"), (k % F.col("total")).alias("o"), ((k + 5) % F.col("total")).alias("d"), (k * 2 % 50).cast("int").alias("pattern_id"), (k % 4).cast("int").alias("from_pos"))
    j = j.withColumn("to_pos", F.col("from_pos") + 3)
    place = lambda key, name: stops.select(F.col("stop_id").alias(key), F.struct("lat", "lon").alias(name))
    at = lambda pos, name: patterns.join(stops, "stop_id").select("pattern_id", F.col("pos").alias(pos), F.struct("lat", "lon").alias(name))
    j = j.join(place("o", "start"), "o").join(place("d", "end"), "d").join(at("from_pos", "board"), ["pattern_id", "from_pos"]).join(at("to_pos", "alight"), ["pattern_id", "to_pos"])
    leg = lambda i, kind, a, b: F.struct(F.lit(i).alias("leg"), F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"))
    three = F.array(leg(0, "walk", "start", "board"), leg(1, "ride", "board", "alight"), leg(2, "walk", "alight", "end"))
    legs = j.select("trip_key", "pattern_id", "from_pos", "to_pos", F.explode(three).alias("l")).select(
        "trip_key", "l.leg", "l.kind", "pattern_id", "from_pos", "to_pos", F.col("l.a.lat").alias("from_lat"), F.col("l.a.lon").alias("from_lon"), F.col("l.b.lat").alias("to_lat"), F.col("l.b.lon").alias("to_lon")
    )
    return features.live_route(legs, patterns, stops).groupBy("trip_key", "leg", "kind").agg(F.count("*").alias("n"), r3(F.max("along")).alias("metres"))
