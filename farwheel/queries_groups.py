"""Queries over aggregations (AGG), windows (WIN), orders (TOP) and set operations (SET)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.feed import DAY, LAT, LON, NOW, table
from farwheel.functions import geo, text
from farwheel.operators import graph, spatial, timetable
from farwheel.queries_rows import _GONE, DELAYS
from farwheel.queries_scalars import _FOLD, _TOKENS, BEARING, HAVERSINE, r3
from farwheel.registry import query

_HERE = HAVERSINE.format("lat", "lon", LAT, LON)


def _here():
    return geo.haversine(F.col("lat"), F.col("lon"), feed.d(LAT), feed.d(LON))


def _joined(col: str, order: str = "v"):
    return F.array_join(F.transform(F.array_sort(F.collect_set(col)), lambda x: x.cast("string")), ",")


@query(
    "AGG-01_calendar_expand",
    """SELECT service_id, CAST(day AS VARCHAR) AS day FROM (SELECT service_id, day, coalesce(added, weekly) AS on_day FROM
      (SELECT o_orderpriority AS service_id, CAST(o_orderdate AS DATE) AS day, max(o_orderkey) % 2 = 0 AS added FROM orders WHERE o_orderdate < TIMESTAMP '1995-03-01' GROUP BY ALL)
      FULL JOIN (SELECT s.service_id, CAST(DATE '1995-01-01' + CAST(i AS INT) AS DATE) AS day, true AS weekly FROM (SELECT DISTINCT o_orderpriority AS service_id FROM orders) s, range(59) t(i)
        WHERE (isodow(CAST(DATE '1995-01-01' + CAST(i AS INT) AS DATE)) - 1 + CAST(service_id[1] AS INT)) % 5 <> 0) USING (service_id, day)) WHERE on_day""",
)
def calendar_expand(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    first = F.substring("service_id", 1, 1).cast("int")
    flags = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: (i + first) % 5 != 0)
    cal = o.select(F.col("o_orderpriority").alias("service_id")).distinct().select("service_id", flags.alias("days"), F.lit("1995-01-01").cast("date").alias("start_date"), F.lit("1995-02-28").cast("date").alias("end_date"))
    exc = o.where(F.col("o_orderdate") < "1995-03-01").select(F.col("o_orderpriority").alias("service_id"), F.col("o_orderdate").cast("date").alias("day"), (F.col("o_orderkey") % 2 == 0).alias("added"), F.col("o_orderkey").alias("n"))
    return timetable.calendar_expand(cal, exc).select("service_id", F.col("day").cast("string").alias("day"))


@query(
    "AGG-02_derive_patterns",
    """SELECT route_id, dir, stops, count(*) AS n_trips, min(trip_id) AS first_trip, arg_min(seqs, trip_id) AS seqs FROM
    (SELECT s.trip_id, t.route_id, t.dir, string_agg(CAST(s.stop_id AS VARCHAR), ',' ORDER BY s.seq) AS stops, string_agg(CAST(s.seq AS VARCHAR), ',' ORDER BY s.seq) AS seqs
    FROM v_raw_stop_times s JOIN v_trips t ON s.trip_id = t.trip_id GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL""",
)
def derive_patterns(spark: SparkSession, sf: str) -> DataFrame:
    p = timetable.derive_patterns(feed.raw_stop_times(spark, sf), feed.trips(spark, sf))
    text_of = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return p.select("route_id", "dir", text_of("stops").alias("stops"), "n_trips", "first_trip", text_of("seqs").alias("seqs"))


@query("AGG-03_pattern_trip_count", "SELECT pattern_id, count(*) AS n FROM v_trips GROUP BY pattern_id")
def pattern_trip_count(spark: SparkSession, sf: str) -> DataFrame:
    return feed.trips(spark, sf).groupBy("pattern_id").agg(F.count("*").alias("n"))


@query("AGG-04_24_stop_mode_set", "SELECT stop_id, string_agg(DISTINCT CAST(route_type AS VARCHAR), ',' ORDER BY CAST(route_type AS VARCHAR)) AS modes, max(CASE WHEN route_type = 1 THEN 1 ELSE 0 END) AS metro FROM v_pattern_stops p JOIN v_routes r ON p.route_id = r.route_id GROUP BY stop_id")
def stop_mode_set(spark: SparkSession, sf: str) -> DataFrame:
    both = feed.pattern_stops(spark, sf).join(feed.routes(spark, sf), "route_id")
    return both.groupBy("stop_id").agg(_joined("route_type").alias("modes"), F.max(F.when(F.col("route_type") == 1, 1).otherwise(0)).alias("metro"))


@query("AGG-05_routes_at", "SELECT stop_id, string_agg(CAST(route_id AS VARCHAR), ',' ORDER BY first, route_id) AS routes FROM (SELECT stop_id, route_id, min(pattern_id * 8 + pos) AS first FROM v_pattern_stops GROUP BY ALL) GROUP BY stop_id")
def routes_at(spark: SparkSession, sf: str) -> DataFrame:
    p = feed.pattern_stops(spark, sf).groupBy("stop_id", "route_id").agg(F.min(F.col("pattern_id") * 8 + F.col("pos")).alias("first"))
    return p.groupBy("stop_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "route_id"))), lambda x: x["route_id"].cast("string")), ",").alias("routes"))


@query(
    "AGG-06_19_route_tiers",
    """SELECT r.route_id, CASE WHEN r.route_type IN (0, 1, 7) THEN 0 WHEN coalesce(m, 0) >= 12 THEN 1 ELSE 2 END AS tier FROM v_routes r LEFT JOIN
    (SELECT route_id, max(n) AS m FROM (SELECT route_id, service_id, count(*) AS n FROM v_trips WHERE base >= 25200 AND base < 32400 GROUP BY ALL) GROUP BY route_id) p ON r.route_id = p.route_id""",
)
def route_tiers(spark: SparkSession, sf: str) -> DataFrame:
    peak = feed.trips(spark, sf).where("base >= 25200 and base < 32400").groupBy("route_id", "service_id").agg(F.count("*").alias("n")).groupBy("route_id").agg(F.max("n").alias("m"))
    tier = F.when(F.col("route_type").isin(0, 1, 7), 0).when(F.coalesce("m", F.lit(0)) >= 12, 1).otherwise(2)
    return feed.routes(spark, sf).join(peak, "route_id", "left").select("route_id", tier.alias("tier"))


_TODAY = f"SELECT route_id, dir, base AS dep, pattern_id, trip_id FROM v_trips t SEMI JOIN v_service_days s ON t.service_id = s.service_id AND s.day = DATE '{DAY}'"


def _today(spark: SparkSession, sf: str) -> DataFrame:
    on = timetable.service_runs(feed.trips(spark, sf), feed.service_days(spark, sf), F.lit(DAY).cast("date"))
    return on.select("route_id", "dir", F.col("base").alias("dep"), "pattern_id", "trip_id")


@query(
    "AGG-07_headway_median",
    f"""SELECT route_id, dir, CAST(CASE WHEN len(g) > 0 THEN g[len(g) // 2 + 1] // 60 END AS INT) AS minutes FROM (SELECT route_id, dir, coalesce(list_sort(list(gap) FILTER (gap IS NOT NULL)), []) AS g
    FROM (SELECT route_id, dir, dep - lag(dep) OVER (PARTITION BY route_id, dir ORDER BY dep) AS gap FROM ({_TODAY})) GROUP BY ALL)""",
)
def headway_median(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.headways(_today(spark, sf), ["route_id", "dir"])


@query("AGG-08_first_last_run", f"SELECT route_id, dir, min(dep) AS first, max(dep) AS last, count(*) AS n FROM ({_TODAY}) GROUP BY ALL")
def first_last_run(spark: SparkSession, sf: str) -> DataFrame:
    return _today(spark, sf).groupBy("route_id", "dir").agg(F.min("dep").alias("first"), F.max("dep").alias("last"), F.count("*").alias("n"))


@query(
    "AGG-09_representative_pattern",
    "SELECT route_id, dir, arg_min(trip_id, (-n, trip_id)) AS trip_id, max(n) AS n FROM (SELECT t.route_id, t.dir, s.trip_id, count(*) AS n FROM v_raw_stop_times s JOIN v_trips t ON s.trip_id = t.trip_id GROUP BY ALL) GROUP BY ALL",
)
def representative_pattern(spark: SparkSession, sf: str) -> DataFrame:
    n = feed.raw_stop_times(spark, sf).groupBy("trip_id").agg(F.count("*").alias("n")).join(feed.trips(spark, sf), "trip_id")
    return n.groupBy("route_id", "dir").agg(F.min(F.struct(-F.col("n"), "trip_id"))["trip_id"].alias("trip_id"), F.max("n").alias("n"))


@query("AGG-10_modal_shape", "SELECT route_id, arg_min(service_id, (-n, service_id)) AS service_id, max(n) AS n FROM (SELECT route_id, service_id, count(*) AS n FROM v_trips GROUP BY ALL) GROUP BY ALL")
def modal_shape(spark: SparkSession, sf: str) -> DataFrame:
    n = feed.trips(spark, sf).groupBy("route_id", "service_id").agg(F.count("*").alias("n"))
    return n.groupBy("route_id").agg(F.min(F.struct(-F.col("n"), "service_id"))["service_id"].alias("service_id"), F.max("n").alias("n"))


_CLUSTERS = f"""WITH RECURSIVE e AS (SELECT a.stop_id AS a, b.stop_id AS b FROM v_stops a JOIN v_stops b ON a.name = b.name WHERE {HAVERSINE.format('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 450),
    c(s, o) AS (SELECT stop_id, stop_id FROM v_stops UNION SELECT c.s, e.b FROM c JOIN e ON c.o = e.a)"""


def _clusters(spark: SparkSession, sf: str) -> DataFrame:
    stops = feed.stops(spark, sf)
    found = graph.components(stops.select(F.col("stop_id").alias("node")), spatial.same_name_pairs(stops, 450))
    return found.select(F.col("node").alias("stop_id"), F.col("component").alias("cluster_id"))


@query("AGG-11_stop_clusters", _CLUSTERS + " SELECT s AS stop_id, min(o) AS cluster_id FROM c GROUP BY s")
def stop_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf)


@query(
    "AGG-12_every_line_options",
    f"""SELECT stop_id, feed, short_name, min(dep) AS dep FROM v_stop_times s JOIN v_routes r ON s.route_id = r.route_id
    WHERE pos < 7 AND dep BETWEEN {NOW} AND {NOW} + 1800 AND EXISTS (SELECT 1 FROM v_service_days d WHERE d.service_id = s.service_id AND d.day = DATE '{DAY}') GROUP BY ALL""",
)
def every_line_options(spark: SparkSession, sf: str) -> DataFrame:
    s = timetable.service_runs(feed.stop_times(spark, sf).where((F.col("pos") < 7) & F.col("dep").between(NOW, NOW + 1800)), feed.service_days(spark, sf), F.lit(DAY).cast("date"))
    return s.join(feed.routes(spark, sf), "route_id").groupBy("stop_id", "feed", "short_name").agg(F.min("dep").alias("dep"))


@query(
    "AGG-13_journey_rollup",
    "SELECT trip_id, min(dep) AS first_dep, max(arr) AS last_arr, count(*) - 1 AS hops, bool_or(stop_id % 7 = 0) AS detour FROM v_stop_times GROUP BY trip_id",
)
def journey_rollup(spark: SparkSession, sf: str) -> DataFrame:
    legs = feed.stop_times(spark, sf).groupBy("trip_id").agg(F.collect_list(F.struct("dep", "arr", "stop_id")).alias("legs"))
    return legs.select("trip_id", F.array_min(F.transform("legs", lambda x: x["dep"])).alias("first_dep"), F.array_max(F.transform("legs", lambda x: x["arr"])).alias("last_arr"), (F.size("legs") - 1).cast("bigint").alias("hops"), F.exists("legs", lambda x: x["stop_id"] % 7 == 0).alias("detour"))


@query(
    "AGG-14_trip_totals",
    """SELECT rider, count(*) AS n, round(sum(walk_m), 3) AS walk, round(sum(ride_m), 3) AS ride, round(sum(greatest(0, direct_m - walk_m)), 3) AS spared,
    count(*) FILTER (x.at >= TIMESTAMP '2024-01-15') AS n_month, round(coalesce(sum(walk_m) FILTER (x.at >= TIMESTAMP '2024-01-15'), 0), 3) AS walk_month FROM v_history x GROUP BY rider""",
)
def trip_totals(spark: SparkSession, sf: str) -> DataFrame:
    month = F.col("at") >= F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return feed.history(spark, sf).groupBy("rider").agg(
        F.count("*").alias("n"), r3(F.sum("walk_m")).alias("walk"), r3(F.sum("ride_m")).alias("ride"), r3(F.sum(F.greatest(feed.d(0), F.col("direct_m") - F.col("walk_m")))).alias("spared"),
        F.count_if(month).alias("n_month"), r3(F.coalesce(F.sum(F.when(month, F.col("walk_m"))), feed.d(0))).alias("walk_month"),
    )


_SEGMENTS = "SELECT r.route_type AS mode, s.stop_id AS f, n.stop_id AS t, s.route_id AS route FROM v_pattern_stops s JOIN v_pattern_stops n ON s.pattern_id = n.pattern_id AND n.pos = s.pos + 1 JOIN v_routes r ON s.route_id = r.route_id"


@query(
    "AGG-15_merge_segments",
    f"SELECT mode, least(f, t) AS a, greatest(f, t) AS b, string_agg(DISTINCT CAST(route AS VARCHAR), ',' ORDER BY CAST(route AS VARCHAR)) AS routes, CAST(count(DISTINCT f <= t) AS INT) AS directions FROM ({_SEGMENTS}) GROUP BY ALL",
)
def merge_segments(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("pattern_id").orderBy("pos")
    hops = feed.pattern_stops(spark, sf).withColumn("to_node", F.lead("stop_id").over(w)).where("to_node is not null").join(feed.routes(spark, sf).select("route_id", "route_type"), "route_id")
    m = graph.merge_segments(hops.select(F.col("route_type").alias("mode"), F.col("stop_id").alias("from_node"), "to_node", F.col("route_id").cast("string").alias("route")))
    return m.select("mode", "a", "b", F.array_join("routes", ",").alias("routes"), "directions")


@query(
    "AGG-16_17_next_strike",
    """SELECT id, strftime(greatest(start, TIMESTAMP '2024-01-10 12:00:00'), '%Y-%m-%d %H:%M:%S') AS at FROM v_alerts WHERE (cause = 4 OR regexp_matches(header, '(?i)sciopero|agitazione sindacale') OR regexp_matches(description, '(?i)sciopero|agitazione sindacale'))
    AND ("end" IS NULL OR "end" > TIMESTAMP '2024-01-10 12:00:00') AND greatest(start, TIMESTAMP '2024-01-10 12:00:00') <= TIMESTAMP '2024-01-12 12:00:00'""",
)
def next_strike(spark: SparkSession, sf: str) -> DataFrame:
    now = F.expr("TIMESTAMP_NTZ '2024-01-10 12:00:00'")
    live = F.filter(F.array(F.struct("start", "end")), lambda p: p["end"].isNull() | (p["end"] > now))
    at = F.array_min(F.transform(live, lambda p: F.greatest(p["start"], now)))
    a = feed.alerts(spark, sf).where(text.is_strike(F.col("cause"), F.col("header"), F.col("description"))).withColumn("at", at)
    return a.where(F.col("at") <= now + F.expr("INTERVAL 48 HOURS")).select("id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("AGG-18_fleet_counts", "SELECT kind, count(*) AS n, count(DISTINCT vehicle) AS vehicles, sum(event_id % 1000) AS bytes FROM v_fixes GROUP BY kind")
def fleet_counts(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("vehicle").alias("vehicles"), F.sum(F.col("event_id") % 1000).alias("bytes"))


@query("AGG-20_line_groups", "SELECT route_type, string_agg(short_name, ',' ORDER BY route_id) AS names FROM v_routes GROUP BY route_type")
def line_groups(spark: SparkSession, sf: str) -> DataFrame:
    g = feed.routes(spark, sf).groupBy("route_type").agg(F.sort_array(F.collect_list(F.struct("route_id", "short_name"))).alias("x"))
    return g.select("route_type", F.array_join(F.array_distinct(F.transform("x", lambda s: s["short_name"])), ",").alias("names"))


@query(
    "AGG-21_quality_report",
    "SELECT kind, count(*) AS n, round(sum(value), 3) AS total, round(list_sort(list(value))[CAST(floor(0.5::DOUBLE * count(*)) AS INT) + 1], 3) AS p50, round(list_sort(list(value))[CAST(floor(0.95::DOUBLE * count(*)) AS INT) + 1], 3) AS p95, round(max(value), 3) AS most FROM v_fixes GROUP BY kind",
)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    # the floor(q n)-th value: counts by whole values tell its bucket, ranks within that bucket the value; no kind is sorted whole
    f = feed.fixes(spark, sf).select("kind", "value", F.floor("value").alias("b"))
    per = f.groupBy("kind", "b").agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.max("value").alias("m"))
    total = per.groupBy("kind").agg(F.sum("n").alias("n"), r3(F.sum("s")).alias("total"), r3(F.max("m")).alias("most"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = total.select("kind", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.floor(feed.d(q) * F.col("n")).alias("rank")) for k, q in (("p50", 0.5), ("p95", 0.95))))).alias("q")).select("kind", "q.k", "q.rank")
    hit = per.select("kind", "b", "n", before.alias("before")).join(ranks, "kind").where("rank >= before and rank < before + n")
    w = Window.partitionBy("kind", "k").orderBy("value")
    at = f.join(hit, ["kind", "b"]).withColumn("i", F.row_number().over(w) - 1).where(F.col("i") == F.col("rank") - F.col("before"))
    found = at.groupBy("kind").agg(*(r3(F.max(F.when(F.col("k") == k, F.col("value")))).alias(k) for k in ("p50", "p95")))
    return total.join(found, "kind").select("kind", "n", "total", "p50", "p95", "most")


@query("AGG-22_components", _CLUSTERS + ", m AS (SELECT s, min(o) AS c FROM c GROUP BY s) SELECT c AS component, count(*) AS nodes FROM m GROUP BY c")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return _clusters(spark, sf).groupBy(F.col("cluster_id").alias("component")).agg(F.count("*").alias("nodes"))


@query("AGG-23_bbox", "SELECT round(min(lat) - 0.01::DOUBLE, 6) AS south, round(max(lat) + 0.01::DOUBLE, 6) AS north, round(min(lon) - 0.01::DOUBLE, 6) AS west, round(max(lon) + 0.01::DOUBLE, 6) AS east FROM v_stops SEMI JOIN v_pattern_stops USING (stop_id)")
def bbox(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stops(spark, sf).join(feed.pattern_stops(spark, sf).select("stop_id"), "stop_id", "left_semi")
    pad = feed.d(0.01)
    return s.agg(F.round(F.min("lat") - pad, 6).alias("south"), F.round(F.max("lat") + pad, 6).alias("north"), F.round(F.min("lon") - pad, 6).alias("west"), F.round(F.max("lon") + pad, 6).alias("east"))


@query("AGG-25_gap_causes", "SELECT kind, event_id % 4 AS cause, count(*) AS n FROM v_fixes GROUP BY ALL")
def gap_causes(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).groupBy("kind", (F.col("event_id") % 4).alias("cause")).agg(F.count("*").alias("n"))


@query("AGG-26_search_groups", _CLUSTERS + f", m AS (SELECT s, min(o) AS c FROM c GROUP BY s) SELECT c AS cluster_id, string_agg(CAST(s AS VARCHAR), ',' ORDER BY round({_HERE}, 6), s) AS members FROM m JOIN v_stops v ON m.s = v.stop_id GROUP BY c")
def search_groups(spark: SparkSession, sf: str) -> DataFrame:
    m = _clusters(spark, sf).join(feed.stops(spark, sf).withColumn("m", F.round(_here(), 6)), "stop_id")
    return m.groupBy("cluster_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("m", "stop_id"))), lambda x: x["stop_id"].cast("string")), ",").alias("members"))


@query("AGG-28_group_lines", "SELECT CASE WHEN feed = 1 THEN 'Regional' WHEN route_type = 1 THEN 'Metro' WHEN route_type = 0 THEN 'Tram' WHEN route_type = 3 THEN 'Bus' WHEN route_type = 7 THEN 'Funicular' ELSE 'Other' END AS part, count(*) AS n FROM v_routes SEMI JOIN v_pattern_stops USING (route_id) GROUP BY ALL")
def group_lines(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("route_type")
    part = F.when(F.col("feed") == 1, "Regional").when(t == 1, "Metro").when(t == 0, "Tram").when(t == 3, "Bus").when(t == 7, "Funicular").otherwise("Other")
    served = feed.routes(spark, sf).join(feed.pattern_stops(spark, sf).select("route_id"), "route_id", "left_semi")
    return served.groupBy(part.alias("part")).agg(F.count("*").alias("n"))


# -- windows --------------------------------------------------------------------------------------------------------


@query("WIN-01_carry_forward", DELAYS)
def carry_forward(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.delay_asof(feed.stop_times(spark, sf), feed.updates(spark, sf))


@query("WIN-02_lag_gaps", "SELECT trip_id, base - lag(base) OVER (PARTITION BY pattern_id ORDER BY base, trip_id) AS gap FROM v_trips")
def lag_gaps(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("pattern_id").orderBy("base", "trip_id")
    return feed.trips(spark, sf).select("trip_id", (F.col("base") - F.lag("base").over(w)).alias("gap"))


@query("WIN-03_rank_trips", "SELECT trip_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY base, trip_id) AS INT) AS rank FROM v_trips")
def rank_trips(spark: SparkSession, sf: str) -> DataFrame:
    return feed.trips(spark, sf).select("trip_id", F.row_number().over(Window.partitionBy("pattern_id").orderBy("base", "trip_id")).alias("rank"))


def _track():
    return Window.partitionBy("vehicle").orderBy("ts", "event_id")


@query(
    "WIN-05_heading",
    f"""SELECT event_id, round({BEARING.format('la', 'lo', 'lb', 'lob')}, 3) AS heading FROM (SELECT event_id, lag(lat) OVER w AS la, lag(lon) OVER w AS lo, lead(lat) OVER w AS lb, lead(lon) OVER w AS lob FROM v_fixes WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id))""",
)
def heading_turn(spark: SparkSession, sf: str) -> DataFrame:
    near = (F.lag("lat").over(_track()), F.lag("lon").over(_track()), F.lead("lat").over(_track()), F.lead("lon").over(_track()))
    return feed.fixes(spark, sf).select("event_id", r3(geo.bearing(*near)).alias("heading"))


@query(
    "WIN-06_cumulative",
    f"""SELECT event_id, round(sum(coalesce(m, 0)) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 2) AS along FROM (SELECT event_id, vehicle, ts, {HAVERSINE.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS m FROM v_fixes WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id))""",
)
def cumulative(spark: SparkSession, sf: str) -> DataFrame:
    hop = geo.haversine(F.lag("lat").over(_track()), F.lag("lon").over(_track()), F.col("lat"), F.col("lon"))
    f = feed.fixes(spark, sf).withColumn("m", F.coalesce(hop, feed.d(0)))
    return f.select("event_id", F.round(F.sum("m").over(_track().rowsBetween(Window.unboundedPreceding, 0)), 2).alias("along"))


#: The tables' fixes lie hours apart: a clock that runs 3,600 times as fast puts them at the seconds that the rules are for.
_FAST = f"""SELECT event_id, vehicle, ts, epoch_us(ts) / 3600000000.0::DOUBLE AS t, {HAVERSINE.format('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')} AS m, epoch_us(ts) / 3600000000.0::DOUBLE - lag(epoch_us(ts)) OVER w / 3600000000.0::DOUBLE AS s FROM v_fixes WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)"""


def _fast(spark: SparkSession, sf: str) -> DataFrame:
    f = feed.fixes(spark, sf).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("t", F.col("us") / feed.d(3.6e9))
    m = geo.haversine(F.lag("lat").over(_track()), F.lag("lon").over(_track()), F.col("lat"), F.col("lon"))
    return f.withColumn("m", m).withColumn("s", F.col("t") - F.lag("t").over(_track()))


@query("WIN-07_derived_speed", f"SELECT event_id, round(CASE WHEN s BETWEEN 0.5::DOUBLE AND 30 THEN m / s ELSE -1 END, 4) AS speed FROM ({_FAST})")
def derived_speed(spark: SparkSession, sf: str) -> DataFrame:
    return _fast(spark, sf).select("event_id", F.round(geo.derived_speed(F.col("m"), F.col("s")), 4).alias("speed"))


@query(
    "WIN-08_trail_window",
    f"""WITH a AS (SELECT event_id, vehicle, t, sum(coalesce(m, 0)) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS along FROM ({_FAST}))
    SELECT a.event_id, bool_or(b.event_id IS NOT NULL) AS moving FROM a LEFT JOIN a b ON a.vehicle = b.vehicle AND b.t BETWEEN a.t - 30 AND a.t - 6 AND (a.along - b.along) / (a.t - b.t) >= 7.5::DOUBLE GROUP BY a.event_id""",
)
def trail_window(spark: SparkSession, sf: str) -> DataFrame:
    """Whether some span of at least 6 of the last 30 seconds, ending now, had a mean speed of 7.5 m/s and more."""
    f = _fast(spark, sf).withColumn("along", F.sum(F.coalesce("m", feed.d(0))).over(_track().rowsBetween(Window.unboundedPreceding, 0)))
    trail = F.collect_list(F.struct("t", "along")).over(Window.partitionBy("vehicle").orderBy("us").rangeBetween(-30 * 3_600_000_000, -6 * 3_600_000_000))
    return f.select("event_id", geo.moving_like_a_vehicle(trail, F.col("t"), F.col("along")).alias("moving"))


@query(
    "WIN-09_dotted_runs",
    """SELECT vehicle, run, count(*) AS n FROM (SELECT *, sum(CASE WHEN was IS DISTINCT FROM flag THEN 1 ELSE 0 END) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM
    (SELECT vehicle, ts, event_id, value > 50 AS flag, lag(value > 50) OVER (PARTITION BY vehicle ORDER BY ts, event_id) AS was FROM v_fixes)) WHERE flag GROUP BY ALL""",
)
def dotted_runs(spark: SparkSession, sf: str) -> DataFrame:
    f = feed.fixes(spark, sf).withColumn("flag", F.col("value") > 50)
    change = F.when(~F.lag("flag").over(_track()).eqNullSafe(F.col("flag")), 1).otherwise(0)
    f = f.withColumn("change", change).withColumn("run", F.sum("change").over(_track().rowsBetween(Window.unboundedPreceding, 0)))
    return f.where("flag").groupBy("vehicle", "run").agg(F.count("*").alias("n"))


@query(
    "WIN-11_12_monotone",
    "SELECT event_id, value >= coalesce(lag(value) OVER w, value) AS rising, round(max(value) OVER (PARTITION BY vehicle ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS clamped FROM v_fixes WINDOW w AS (PARTITION BY vehicle ORDER BY ts, event_id)",
)
def monotone(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).select("event_id", (F.col("value") >= F.coalesce(F.lag("value").over(_track()), "value")).alias("rising"), r3(F.max("value").over(_track().rowsBetween(Window.unboundedPreceding, 0))).alias("clamped"))


@query(
    "WIN-13_last_passed",
    f"""SELECT trip_id, max(pos) AS passed FROM (SELECT trip_id, pos, bool_and(dep <= {NOW}) OVER (PARTITION BY trip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ok FROM v_stop_times) WHERE ok GROUP BY trip_id""",
)
def last_passed(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("trip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    s = feed.stop_times(spark, sf).withColumn("ok", F.min(F.col("dep") <= NOW).over(w))
    return s.where("ok").groupBy("trip_id").agg(F.max("pos").alias("passed"))


@query(
    "WIN-14_resample",
    """SELECT pattern_id, pos, CAST(i AS INT) AS i, round(a.lat + (b.lat - a.lat) * i / 8, 6) AS lat, round(a.lon + (b.lon - a.lon) * i / 8, 6) AS lon FROM v_pattern_stops s JOIN v_pattern_stops n USING (pattern_id) JOIN v_stops a ON s.stop_id = a.stop_id JOIN v_stops b ON n.stop_id = b.stop_id, range(8) t(i) WHERE n.pos = s.pos + 1""".replace("SELECT pattern_id, pos,", "SELECT pattern_id, s.pos AS pos,"),
)
def resample(spark: SparkSession, sf: str) -> DataFrame:
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf).select("stop_id", "lat", "lon"), "stop_id")
    w = Window.partitionBy("pattern_id").orderBy("pos")
    hops = at.select("pattern_id", "pos", "lat", "lon", F.lead("lat").over(w).alias("lat2"), F.lead("lon").over(w).alias("lon2")).where("lat2 is not null").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(7))))
    mid = lambda a, b: F.round(F.col(a) + (F.col(b) - F.col(a)) * F.col("i") / 8, 6)
    return hops.select("pattern_id", "pos", "i", mid("lat", "lat2").alias("lat"), mid("lon", "lon2").alias("lon"))


# -- orders and limits ----------------------------------------------------------------------------------------------

_BOARD = f"""SELECT stop_id, trip_id, pos, CAST(dep + day_shift * 86400 AS INT) AS scheduled, CAST(dep + day_shift * 86400 + coalesce(d.delay, 0) AS INT) AS expected FROM v_stop_times s LEFT JOIN ({DELAYS}) d USING (trip_id, pos), (SELECT unnest([0, -1]) AS day_shift)
    WHERE pos < 7 AND dep + day_shift * 86400 BETWEEN {NOW} - 1800 AND {NOW} + 10800 AND dep + day_shift * 86400 + coalesce(d.delay, 0) >= {NOW}
    AND EXISTS (SELECT 1 FROM v_service_days v WHERE v.service_id = s.service_id AND v.day = DATE '{DAY}' + day_shift)
    AND NOT (day_shift = 0 AND EXISTS (SELECT 1 FROM ({_GONE}) g WHERE g.trip_id = s.trip_id AND g.pos = s.pos))"""


def board(spark: SparkSession, sf: str) -> DataFrame:
    s, u = feed.stop_times(spark, sf), feed.updates(spark, sf)
    last = feed.pattern_stops(spark, sf).groupBy("pattern_id").agg(F.max("pos").alias("last_pos"))
    return timetable.departures(s, F.broadcast(last), feed.service_days(spark, sf), DAY, NOW, timetable.delay_asof(s, u), timetable.unavailable(s, u))


@query("TOP-01_next_departures", f"SELECT stop_id, trip_id, pos, scheduled, expected FROM (SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY expected, trip_id, pos) AS k FROM ({_BOARD})) WHERE k <= 5")
def next_departures(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.first_n(board(spark, sf), ["stop_id"], 5, "expected", "trip_id", "pos").select("stop_id", "trip_id", "pos", F.col("scheduled").cast("int").alias("scheduled"), F.col("expected").cast("int").alias("expected"))


_LABELS = "SELECT event_id, user_id AS request, CAST(event_id * 7919 % 7200 AS INT) AS arr, round(value, 2) AS walk, CAST(event_id % 3 AS INT) AS rides FROM events"


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf, "events").select("event_id", F.col("user_id").alias("request"), (e * 7919 % 7200).cast("int").alias("arr"), F.round("value", 2).alias("walk"), (e % 3).cast("int").alias("rides"))


@query(
    "TOP-02_03_journey_order",
    f"""SELECT event_id, CAST(row_number() OVER (PARTITION BY request ORDER BY arr, walk, event_id) AS INT) AS fastest, CAST(row_number() OVER (PARTITION BY request ORDER BY walk + 2.0::DOUBLE * (arr / 60), arr, event_id) AS INT) AS balanced FROM ({_LABELS})""",
)
def journey_order(spark: SparkSession, sf: str) -> DataFrame:
    by = Window.partitionBy("request")
    score = geo.balanced_score(F.col("walk"), F.col("arr") / 60, F.lit(False))
    return _labels(spark, sf).select("event_id", F.row_number().over(by.orderBy("arr", "walk", "event_id")).alias("fastest"), F.row_number().over(by.orderBy(score, "arr", "event_id")).alias("balanced"))


@query("TOP-04_07_pareto_bag", f"SELECT event_id FROM (SELECT event_id, arr, min(arr) OVER (PARTITION BY request ORDER BY walk, arr, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({_LABELS})) WHERE b IS NULL OR arr < b")
def pareto_bag(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.skyline(_labels(spark, sf), ["request"], "event_id").select("event_id")


@query("TOP-05_pareto_per_rides", f"SELECT event_id FROM (SELECT event_id, arr, min(arr) OVER (PARTITION BY request, rides ORDER BY walk, arr, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM ({_LABELS})) WHERE b IS NULL OR arr < b")
def pareto_per_rides(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.skyline(_labels(spark, sf), ["request", "rides"], "event_id").select("event_id")


@query(
    "TOP-06_pareto3",
    f"""WITH l AS ({_LABELS}) SELECT a.event_id FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.request = a.request AND b.arr >= a.arr AND b.walk <= a.walk AND b.rides <= a.rides
    AND (b.arr > a.arr OR b.walk < a.walk OR b.rides < a.rides))""",
)
def pareto3(spark: SparkSession, sf: str) -> DataFrame:
    one = _labels(spark, sf)
    two = one.select(*(F.col(c).alias(f"{c}2") for c in ("request", "arr", "walk", "rides")))
    beats = (F.col("request") == F.col("request2")) & (F.col("arr2") >= F.col("arr")) & (F.col("walk2") <= F.col("walk")) & (F.col("rides2") <= F.col("rides"))
    strict = (F.col("arr2") > F.col("arr")) | (F.col("walk2") < F.col("walk")) | (F.col("rides2") < F.col("rides"))
    return one.join(two, beats & strict, "left_anti").select("event_id")


@query("TOP-08_earliest_trip", f"SELECT pattern_id, pos, arg_min(trip_id, (dep, trip_id)) AS trip_id, min(dep) AS dep FROM v_stop_times s WHERE dep >= {NOW} AND EXISTS (SELECT 1 FROM v_service_days d WHERE d.service_id = s.service_id AND d.day = DATE '{DAY}') GROUP BY ALL")
def earliest_trip(spark: SparkSession, sf: str) -> DataFrame:
    s = timetable.service_runs(feed.stop_times(spark, sf).where(F.col("dep") >= NOW), feed.service_days(spark, sf), F.lit(DAY).cast("date"))
    # the least number first, then its trip: least structs over all rows would be sorted
    first = s.groupBy("pattern_id", "pos").agg(F.min("dep").alias("dep"))
    return s.join(F.broadcast(first), ["pattern_id", "pos", "dep"]).groupBy("pattern_id", "pos", "dep").agg(F.min("trip_id").alias("trip_id")).select("pattern_id", "pos", "trip_id", "dep")


@query(
    "TOP-09_10_search_stops",
    f"""SELECT stop_id, round(m, 3) AS metres FROM (SELECT stop_id, {_HERE} AS m, {_TOKENS.format('name')} AS t FROM v_stops SEMI JOIN v_pattern_stops USING (stop_id)) WHERE len(list_filter(t, lambda x: starts_with(x, '1'))) > 0 ORDER BY round(m, 6), stop_id LIMIT 12""",
)
def search_stops(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stops(spark, sf).join(feed.pattern_stops(spark, sf).select("stop_id"), "stop_id", "left_semi")
    return s.where(text.matches_query(F.col("name"), F.lit("1"))).withColumn("m", _here()).orderBy(F.round("m", 6), "stop_id").limit(12).select("stop_id", r3("m").alias("metres"))


@query(
    "TOP-11_13_search_routes",
    f"""SELECT route_id, CAST(row_number() OVER (ORDER BY f <> '1', try_cast(f AS INT) IS NULL, try_cast(f AS INT), f, route_id) AS INT) AS rank FROM (SELECT route_id, {_FOLD.format('short_name')} AS f FROM v_routes) WHERE starts_with(f, '1') ORDER BY rank LIMIT 12""",
)
def search_routes(spark: SparkSession, sf: str) -> DataFrame:
    f = text.fold(F.col("short_name"))
    number = F.col("f").try_cast("int")
    order = ((F.col("f") != "1"), number.isNull(), number, F.col("f"), F.col("route_id"))
    hits = feed.routes(spark, sf).withColumn("f", f).where(F.startswith("f", F.lit("1"))).orderBy(*order).limit(12)
    return hits.withColumn("rank", F.row_number().over(Window.orderBy(*order))).select("route_id", "rank")


@query("TOP-12_search_vehicles", f"SELECT vehicle FROM (SELECT DISTINCT vehicle FROM v_fixes) WHERE contains({_FOLD.format('CAST(vehicle AS VARCHAR)')}, '4') ORDER BY vehicle LIMIT 8")
def search_vehicles(spark: SparkSession, sf: str) -> DataFrame:
    v = feed.fixes(spark, sf).select("vehicle").distinct()
    return v.where(F.contains(text.fold(F.col("vehicle").cast("string")), F.lit("4"))).orderBy("vehicle").limit(8)


@query("TOP-14_15_candidates_topk", f"SELECT vehicle, event_id, CAST(k AS INT) AS rank FROM (SELECT vehicle, event_id, row_number() OVER (PARTITION BY vehicle ORDER BY round({_HERE}, 6), event_id) AS k FROM v_fixes) WHERE k <= 8")
def candidates_topk(spark: SparkSession, sf: str) -> DataFrame:
    return timetable.first_n(feed.fixes(spark, sf).withColumn("m", F.round(_here(), 6)), ["vehicle"], 8, "m", "event_id").select("vehicle", "event_id", "rank")


@query("TOP-16_recents_cap", "SELECT vehicle, event_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT *, row_number() OVER (PARTITION BY vehicle, k ORDER BY ts DESC, event_id DESC) AS d FROM v_fixes) WHERE d = 1) WHERE n <= 10")
def recents_cap(spark: SparkSession, sf: str) -> DataFrame:
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    once = timetable.first_n(feed.fixes(spark, sf), ["vehicle", "k"], 1, *newest).drop("rank")
    return timetable.first_n(once, ["vehicle"], 10, *newest).select("vehicle", "event_id")


@query("TOP-17_18_near_board", f"SELECT stop_id, trip_id, expected FROM (SELECT b.*, row_number() OVER (PARTITION BY stop_id ORDER BY expected, trip_id, pos) AS k FROM ({_BOARD}) b SEMI JOIN (SELECT stop_id FROM v_stops ORDER BY round({_HERE}, 6), stop_id LIMIT 12) n USING (stop_id)) WHERE k <= 3")
def near_board(spark: SparkSession, sf: str) -> DataFrame:
    near = feed.stops(spark, sf).orderBy(F.round(_here(), 6), "stop_id").limit(12).select("stop_id")
    b = board(spark, sf).join(F.broadcast(near), "stop_id", "left_semi")
    return timetable.first_n(b, ["stop_id"], 3, "expected", "trip_id", "pos").select("stop_id", "trip_id", F.col("expected").cast("int").alias("expected"))


@query("TOP-20_newest_release", "SELECT event_id FROM events WHERE event_id % 9 <> 0 OR event_id % 4 = 0 ORDER BY event_id % 3 DESC, event_id % 11 DESC, event_id % 5 DESC, CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE 1073741824 END DESC, event_id LIMIT 1")
def newest_release(spark: SparkSession, sf: str) -> DataFrame:
    from farwheel.queries_scalars import _VERSION

    v = table(spark, sf, "events").where("event_id % 9 <> 0 or event_id % 4 = 0").select("event_id", text.version_key(F.expr(_VERSION)).alias("k"))
    return v.groupBy().agg(F.max(F.struct("k", -F.col("event_id"), "event_id"))["event_id"].alias("event_id"))


# -- sets -----------------------------------------------------------------------------------------------------------


@query(
    "SET-01_merge_feeds",
    f"""WITH r AS (SELECT event_id, lat, lon FROM v_fixes WHERE kind = 'click'),
    n AS (SELECT event_id, stop_id FROM (SELECT r.event_id, s.stop_id, row_number() OVER (PARTITION BY r.event_id ORDER BY {HAVERSINE.format('r.lat', 'r.lon', 's.lat', 's.lon')}, s.stop_id) AS k FROM r JOIN v_stops s ON {HAVERSINE.format('r.lat', 'r.lon', 's.lat', 's.lon')} < 150) WHERE k = 1)
    SELECT CAST(stop_id AS VARCHAR) AS id FROM v_stops UNION ALL SELECT 'R:' || event_id FROM r ANTI JOIN n USING (event_id)""",
)
def merge_feeds(spark: SparkSession, sf: str) -> DataFrame:
    own = feed.stops(spark, sf)
    regional = feed.fixes(spark, sf).where("kind = 'click'").select("event_id", "lat", "lon")
    snapped = spatial.within(regional, spatial.second(own, "stop_id", "lat", "lon"), 150).where("metres < 150").select("event_id")
    new = regional.join(snapped, "event_id", "left_anti").select(F.concat(F.lit("R:"), "event_id").alias("id"))
    return own.select(F.col("stop_id").cast("string").alias("id")).unionByName(new)


@query("SET-02_dedupe_journeys", f"SELECT request, arr, rides, min(event_id) AS event_id FROM ({_LABELS}) GROUP BY ALL")
def dedupe_journeys(spark: SparkSession, sf: str) -> DataFrame:
    return _labels(spark, sf).groupBy("request", "arr", "rides").agg(F.min("event_id").alias("event_id"))


@query("SET-03_05_array_sets", "SELECT stop_id, array_to_string(list_sort(list_filter(list_distinct(r), lambda x: x NOT IN (3, 7))), ',') AS kept FROM (SELECT stop_id, list(route_type) AS r FROM v_pattern_stops JOIN v_routes USING (route_id) GROUP BY stop_id)")
def array_sets(spark: SparkSession, sf: str) -> DataFrame:
    g = feed.pattern_stops(spark, sf).join(feed.routes(spark, sf), "route_id").groupBy("stop_id").agg(F.collect_set("route_type").alias("r"))
    kept = F.array_sort(F.array_except("r", F.array(F.lit(3), F.lit(7))))
    return g.select("stop_id", F.array_join(F.transform(kept, lambda x: x.cast("string")), ",").alias("kept"))


@query("SET-06_07_08_distinct_rows", "SELECT vehicle, k, min(event_id) AS event_id FROM v_fixes GROUP BY ALL")
def distinct_rows(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).groupBy("vehicle", "k").agg(F.min("event_id").alias("event_id"))
