"""Queries over the scalar functions (SCL): each applies them to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farwheel import feed
from farwheel.feed import LAT, LON, table
from farwheel.functions import geo, text, times
from farwheel.registry import query

_FOLD = f"translate(lower({{}}), '{text.ACCENTS}', '{text.PLAIN}')"
_TOKENS = "list_filter(string_split_regex(" + _FOLD + ", '[^a-z0-9]+'), lambda t: t <> '')"
_HAVERSINE = "2 * 6371000.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2))))"
_BEARING = "((degrees(atan2(sin(radians({3} - {1})) * cos(radians({2})), cos(radians({0})) * sin(radians({2})) - sin(radians({0})) * cos(radians({2})) * cos(radians({3} - {1})))) + 360) % 360)"
HAVERSINE, BEARING = _HAVERSINE, _BEARING


def r3(c):
    return F.round(c, 3)


@query("SCL-01_clean_stop_name", r"SELECT stop_id, trim(regexp_replace(raw_name, '^Fermata \S+ - ', '')) AS name FROM v_stops")
def clean_stop_name(spark: SparkSession, sf: str) -> DataFrame:
    return feed.stops(spark, sf).select("stop_id", text.clean_stop_name(F.col("raw_name")).alias("name"))


@query("SCL-02_fold", f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded FROM documents")
def fold(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.md5(text.fold(F.col("text"))).alias("folded"))


@query("SCL-03_tokens", f"SELECT doc_id, CAST(len(t) AS INT) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {_TOKENS.format('text')} AS t FROM documents)")
def tokens(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "documents").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ")).alias("tokens"))


@query(
    "SCL-04_matches_query",
    f"""SELECT stop_id, q, len(w) > 0 AND len(list_filter(w, lambda x: len(list_filter(t, lambda y: starts_with(y, x))) > 0 OR starts_with(array_to_string(t, ''), x))) = len(w) AS matches
    FROM (SELECT stop_id, q, {_TOKENS.format('raw_name')} AS t, {_TOKENS.format('q')} AS w FROM v_stops, (SELECT unnest(['natión 1', 'fermata 7', '1nat', '']) AS q))""",
)
def matches_query(spark: SparkSession, sf: str) -> DataFrame:
    q = F.explode(F.array(*map(F.lit, ("natión 1", "fermata 7", "1nat", ""))))
    return feed.stops(spark, sf).select("stop_id", "raw_name", q.alias("q")).select("stop_id", "q", text.matches_query(F.col("raw_name"), F.col("q")).alias("matches"))


@query("SCL-05_looks_like_line", f"SELECT route_id, regexp_matches({_FOLD.format('trim(short_name)')}, '^[0-9]{{1,3}}[a-z/]?$') AS by_number, regexp_matches({_FOLD.format('trim(long_name)')}, '^[0-9]{{1,3}}[a-z/]?$') AS by_name FROM v_routes")
def looks_like_line(spark: SparkSession, sf: str) -> DataFrame:
    return feed.routes(spark, sf).select("route_id", text.looks_like_line(F.col("short_name")).alias("by_number"), text.looks_like_line(F.col("long_name")).alias("by_name"))


@query(
    "SCL-06_pattern_signature",
    "SELECT p.pattern_id, r.short_name || '|' || r.route_type || '|' || string_agg(CAST(p.stop_id AS VARCHAR), ',' ORDER BY p.pos) AS signature FROM v_pattern_stops p JOIN v_routes r ON p.route_id = r.route_id GROUP BY p.pattern_id, r.short_name, r.route_type",
)
def pattern_signature(spark: SparkSession, sf: str) -> DataFrame:
    p = feed.pattern_stops(spark, sf).groupBy("pattern_id", "route_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda x: x["stop_id"]).alias("s"))
    both = p.join(feed.routes(spark, sf), "route_id")
    return both.select("pattern_id", text.pattern_signature(F.col("short_name"), F.col("route_type"), F.col("s")).alias("signature"))


@query(
    "SCL-07_pattern_key",
    "SELECT trip_id, md5(route_id || '|' || dir || '|' || k) AS key FROM (SELECT s.trip_id, t.route_id, t.dir, string_agg(CAST(s.stop_id AS VARCHAR), ',' ORDER BY s.seq) AS k FROM v_raw_stop_times s JOIN v_trips t ON s.trip_id = t.trip_id GROUP BY ALL)",
)
def pattern_key(spark: SparkSession, sf: str) -> DataFrame:
    k = feed.raw_stop_times(spark, sf).groupBy("trip_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "stop_id"))), lambda x: x["stop_id"].cast("string")), ",").alias("k"))
    return k.join(feed.trips(spark, sf), "trip_id").select("trip_id", F.md5(F.concat_ws("|", "route_id", "dir", "k")).alias("key"))


@query("SCL-08_shade_of", "SELECT route_id, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(short_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) & 2147483647) % 6 AS INT) AS shade FROM v_routes")
def shade_of(spark: SparkSession, sf: str) -> DataFrame:
    return feed.routes(spark, sf).select("route_id", text.shade_of(F.col("short_name")).alias("shade"))


@query(
    "SCL-10_redact_positions",
    r"SELECT event_id, regexp_replace('fix ' || printf('%.4f', lat) || ',' || printf('%.4f', lon) || ' ok', '-?\d{1,3}\.\d{3,},-?\d{1,3}\.\d{3,}', '…', 'g') AS line FROM v_fixes",
)
def redact_positions(spark: SparkSession, sf: str) -> DataFrame:
    line = F.format_string("fix %.4f,%.4f ok", "lat", "lon")
    return feed.fixes(spark, sf).select("event_id", text.without_positions(line).alias("line"))


@query("SCL-12_mode_key", "SELECT route_id, CASE route_type WHEN 0 THEN 'tram' WHEN 1 THEN 'metro' WHEN 7 THEN 'funicular' ELSE 'bus' END AS mode, CASE route_type WHEN 0 THEN 0 WHEN 3 THEN 1 ELSE 2 END AS draw_rank FROM v_routes")
def mode_key(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("route_type")
    return feed.routes(spark, sf).select("route_id", text.mode_key(t).alias("mode"), text.draw_rank(t).alias("draw_rank"))


_VERSION = "'v' || event_id % 3 || '.' || event_id % 11 || '.' || event_id % 5 || CASE WHEN event_id % 4 = 0 THEN '-beta.' || event_id % 7 WHEN event_id % 9 = 0 THEN 'x' ELSE '' END"


@query(
    "SCL-13_version_key",
    f"""SELECT event_id, CAST(event_id % 3 AS INT) AS major, CAST(event_id % 11 AS INT) AS minor, CAST(event_id % 5 AS INT) AS patch,
    CAST(CASE WHEN event_id % 4 = 0 THEN event_id % 7 ELSE 1073741824 END AS INT) AS pre FROM events""",
)
def version_key(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "events").select("event_id", F.expr(_VERSION).alias("v")).select("event_id", text.version_key(F.col("v")).alias("k"))
    return v.select("event_id", "k.major", "k.minor", "k.patch", "k.pre")


@query(
    "SCL-16_labels",
    """SELECT event_id, CASE WHEN m < 60 THEN m || ' min' ELSE (m // 60) || ' h ' || lpad(CAST(m % 60 AS VARCHAR), 2, '0') END AS duration,
    CASE WHEN n = 0 THEN 'diretto' WHEN n = 1 THEN '1 cambio' ELSE n || ' cambi' END AS transfers,
    lpad(CAST(h AS VARCHAR), 2, '0') || ':' || lpad(CAST(mi AS VARCHAR), 2, '0') AS clock,
    CASE WHEN x < -60 THEN 'partito' WHEN x < 60 THEN 'parte ora' WHEN x // 60 < 60 THEN 'parte tra ' || x // 60 || ' min' WHEN x // 60 % 60 = 0 THEN 'parte tra ' || x // 3600 || ' h' ELSE 'parte tra ' || x // 3600 || ' h ' || x // 60 % 60 || ' min' END AS leaves
    FROM (SELECT event_id, CAST(round(event_id / 60) AS INT) AS m, event_id % 4 AS n, (event_id * 37 % 86400) // 3600 AS h, (event_id * 37 % 3600) // 60 AS mi, event_id * 13 % 9000 - 500 AS x FROM events)""",
)
def labels(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    left = e * 13 % 9000 - 500
    return table(spark, sf, "events").select(
        "event_id", text.duration_label(e).alias("duration"), text.transfers_label(e % 4).alias("transfers"), times.hhmm(e * 37).alias("clock"), text.leaves_in_label(left, F.lit(True), F.lit("")).alias("leaves")
    )


@query(
    "SCL-17_legs_summary",
    "SELECT trip_id, string_agg(pos || '@' || stop_id, ' ' ORDER BY pos) AS line FROM v_stop_times GROUP BY trip_id",
)
def legs_summary(spark: SparkSession, sf: str) -> DataFrame:
    legs = feed.stop_times(spark, sf).groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))).alias("x"))
    return legs.select("trip_id", F.array_join(F.transform("x", lambda s: F.concat(s["pos"], F.lit("@"), s["stop_id"])), " ").alias("line"))


@query(
    "SCL-20_parse_gtfs_time",
    "SELECT trip_id, pos, dep AS seconds FROM v_stop_times",
)
def parse_gtfs_time(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stop_times(spark, sf).select("trip_id", "pos", times.clock(F.col("dep")).alias("clock"))
    return s.select("trip_id", "pos", times.parse_gtfs_time(F.col("clock")).alias("seconds"))


@query("SCL-21_parse_date", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def parse_date(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", times.parse_date(F.date_format("o_orderdate", "yyyyMMdd")).cast("string").alias("day"))


@query("SCL-22_epoch_day", "SELECT o_orderkey, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS INT) AS epoch_day, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def epoch_day(spark: SparkSession, sf: str) -> DataFrame:
    n = F.unix_date(F.col("o_orderdate").cast("date"))
    return table(spark, sf, "orders").select("o_orderkey", n.alias("epoch_day"), F.date_from_unix_date(n).cast("string").alias("day"))


@query("SCL-23_weekday", "SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INT) AS weekday FROM orders")
def weekday(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", times.weekday(F.unix_date(F.col("o_orderdate").cast("date"))).alias("weekday"))


@query("SCL-24_service_day_time", "SELECT trip_id, pos, strftime(TIMESTAMP '2024-03-31' + to_seconds(dep + 43200), '%Y-%m-%d %H:%M:%S') AS at FROM v_stop_times")
def service_day_time(spark: SparkSession, sf: str) -> DataFrame:
    at = times.service_day_time(F.lit("2024-03-31").cast("date"), F.col("dep") + 43200)
    return feed.stop_times(spark, sf).select("trip_id", "pos", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("at"))


@query("SCL-25_seconds_of_day", "SELECT event_id, CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS INT) AS seconds FROM events")
def seconds_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", times.seconds_of_day(F.col("ts")).alias("seconds"))


@query("SCL-26_walk_seconds", "SELECT event_id, CAST(round(value * 1.35::DOUBLE / 1.2::DOUBLE) AS INT) AS seconds FROM events")
def walk_seconds(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", times.walk_seconds(F.col("value")).alias("seconds"))


@query(
    "SCL-27_28_29_clock_rules",
    """SELECT event_id, CAST(CASE WHEN x <= 30 THEN 0 ELSE ceil(x / 60) END AS INT) AS until, CAST(round(x / 60) AS INT) AS late,
    CASE WHEN (event_id * 37) % 86400 < 28800 - 1800 THEN '2024-01-11' ELSE '2024-01-10' END AS day FROM (SELECT event_id, event_id % 4000 - 300 AS x FROM events)""",
)
def clock_rules(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("event_id") % 4000 - 300
    day = times.picked_day(F.lit(feed.DAY).cast("date"), F.col("event_id") * 37 % 86400, F.lit(feed.NOW))
    return table(spark, sf, "events").select("event_id", times.minutes_until(x).alias("until"), times.minutes_late(x).alias("late"), day.cast("string").alias("day"))


@query(
    "SCL-30_31_32_33_distance_bearing",
    f"""SELECT event_id, round({_HAVERSINE.format('lat', 'lon', LAT, LON)}, 3) AS metres,
    round(sqrt(pow(({LAT} - lat) * 111194.9266::DOUBLE, 2) + pow(({LON} - lon) * 111194.9266::DOUBLE * cos(radians((lat + {LAT}) / 2)), 2)), 3) AS flat,
    round(b, 3) AS bearing, round(least(abs(b - 90) % 360, 360 - abs(b - 90) % 360), 3) AS delta, round(CASE WHEN (b - 90 + 360) % 360 > 180 THEN (b - 90 + 360) % 360 - 360 ELSE (b - 90 + 360) % 360 END, 3) AS turn,
    CASE WHEN abs(CASE WHEN (b - 90 + 360) % 360 > 180 THEN (b - 90 + 360) % 360 - 360 ELSE (b - 90 + 360) % 360 END) < 60 THEN 'slight' WHEN abs(CASE WHEN (b - 90 + 360) % 360 > 180 THEN (b - 90 + 360) % 360 - 360 ELSE (b - 90 + 360) % 360 END) < 130 THEN 'plain' ELSE 'sharp' END AS class
    FROM (SELECT event_id, lat, lon, {_BEARING.format('lat', 'lon', LAT, LON)} AS b FROM v_fixes)""",
)
def distance_bearing(spark: SparkSession, sf: str) -> DataFrame:
    to = feed.d(LAT), feed.d(LON)
    at = F.col("lat"), F.col("lon")
    f = feed.fixes(spark, sf).withColumn("b", geo.bearing(*at, *to))
    turn = geo.signed_angle(feed.d(90), F.col("b"))
    return f.select("event_id", r3(geo.haversine(*at, *to)).alias("metres"), r3(geo.equirect(*at, *to)).alias("flat"), r3("b").alias("bearing"), r3(geo.bearing_delta(F.col("b"), feed.d(90))).alias("delta"), r3(turn).alias("turn"), geo.turn_class(turn).alias("class"))


@query(
    "SCL-34_project_on_segment",
    f"""SELECT event_id, round(t, 6) AS t, round(sqrt(pow(px - t * 2000, 2) + pow(py - t * 500, 2)), 3) AS metres
    FROM (SELECT event_id, px, py, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (px * 2000 + py * 500) / (2000.0::DOUBLE * 2000 + 500.0::DOUBLE * 500))) AS t
    FROM (SELECT event_id, (lon - 7.6::DOUBLE) * 111194.9266::DOUBLE * cos(radians(45.0::DOUBLE)) AS px, (lat - 45.0::DOUBLE) * 111194.9266::DOUBLE AS py FROM v_fixes))""",
)
def project_on_segment(spark: SparkSession, sf: str) -> DataFrame:
    x, y = geo.plane(F.col("lat"), F.col("lon"), 45.0, 7.6)
    p = geo.project(x, y, feed.d(0), feed.d(0), feed.d(2000), feed.d(500))
    return feed.fixes(spark, sf).select("event_id", p.alias("p")).select("event_id", F.round("p.t", 6).alias("t"), r3("p.metres").alias("metres"))


_SIDE = "(({2} - {0}) * ({5} - {1}) - ({3} - {1}) * ({4} - {0}))"


@query(
    "SCL-35_segment_cross",
    f"""SELECT event_id, {_SIDE.format('ax', 'ay', 'bx', 'by_', 'cx', 'cy')} * {_SIDE.format('ax', 'ay', 'bx', 'by_', 'dx', 'dy')} < 0 AND {_SIDE.format('cx', 'cy', 'dx', 'dy', 'ax', 'ay')} * {_SIDE.format('cx', 'cy', 'dx', 'dy', 'bx', 'by_')} < 0 AS crosses
    FROM (SELECT event_id, 0.0::DOUBLE AS ax, 0.0::DOUBLE AS ay, 100.0::DOUBLE AS bx, CAST(k AS DOUBLE) AS by_, CAST(event_id % 150 AS DOUBLE) AS cx, -20.0::DOUBLE AS cy, CAST(event_id % 130 AS DOUBLE) AS dx, CAST(event_id % 61 AS DOUBLE) AS dy FROM v_fixes)""",
)
def segment_cross(spark: SparkSession, sf: str) -> DataFrame:
    k, e = F.col("k").cast("double"), F.col("event_id")
    c = geo.crosses(feed.d(0), feed.d(0), feed.d(100), k, (e % 150).cast("double"), feed.d(-20), (e % 130).cast("double"), (e % 61).cast("double"))
    return feed.fixes(spark, sf).select("event_id", c.alias("crosses"))


@query(
    "SCL-36_37_cells",
    "SELECT stop_id, CAST(floor(lat / 0.002::DOUBLE) AS INT) AS cell_y, CAST(floor(lon / 0.002::DOUBLE) AS INT) AS cell_x, CAST(round(lat * 1000000) AS INT) AS lat_e6, CAST(round(lon * 1000000) AS INT) AS lon_e6 FROM v_stops",
)
def cells(spark: SparkSession, sf: str) -> DataFrame:
    y, x = geo.cell(F.col("lat"), F.col("lon"), 0.002, 0.002)
    return feed.stops(spark, sf).select("stop_id", y.alias("cell_y"), x.alias("cell_x"), geo.fixed(F.col("lat")).alias("lat_e6"), geo.fixed(F.col("lon")).alias("lon_e6"))


@query(
    "SCL-38_40_47_53_scores",
    """SELECT event_id, round(value + 2.0::DOUBLE * (event_id % 90) + CASE WHEN event_id % 7 = 0 THEN 150 ELSE 0 END, 3) AS score,
    round(1.5::DOUBLE * least(1 + 0.4::DOUBLE * (event_id % 9), 3.0::DOUBLE), 3) AS width, round(greatest(0.0::DOUBLE, event_id % 500 - value), 3) AS spared, event_id % 6000 * 30720 AS bytes FROM events""",
)
def scores(spark: SparkSession, sf: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    return table(spark, sf, "events").select(
        "event_id", r3(geo.balanced_score(v, e % 90, e % 7 == 0)).alias("score"), r3(geo.merged_width(1.5, e % 9 + 1)).alias("width"), r3(F.greatest(feed.d(0), e % 500 - v)).alias("spared"), (e % 6000 * 30720).alias("bytes")
    )


@query(
    "SCL-39_walk_edge_cost",
    """SELECT event_id, round(value * (f * CASE WHEN c THEN 0.9::DOUBLE ELSE 1.0::DOUBLE END) + CASE WHEN kind = 4 THEN [20.0::DOUBLE, 25.0::DOUBLE, 30.0::DOUBLE, 120.0::DOUBLE][sub + 1] ELSE 0 END, 6) AS cost FROM (
    SELECT *, CASE kind WHEN 0 THEN [1.0::DOUBLE, 1.0::DOUBLE, 0.95::DOUBLE, 1.3::DOUBLE][sub + 1] WHEN 1 THEN [1.0::DOUBLE, 0.95::DOUBLE, 1.3::DOUBLE][least(sub, 2) + 1]
      WHEN 2 THEN [[1.15::DOUBLE, 1.0::DOUBLE, 1.6::DOUBLE], [1.25::DOUBLE, 1.05::DOUBLE, 2.0::DOUBLE], [1.4::DOUBLE, 1.1::DOUBLE, 2.5::DOUBLE]][least(sub, 2) + 1][least(walk, 2) + 1] WHEN 3 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS f
    FROM (SELECT event_id, value, event_id % 5 AS kind, event_id // 5 % 4 AS sub, event_id // 20 % 4 AS walk, event_id % 7 = 0 AS c FROM events))""",
)
def walk_edge_cost(spark: SparkSession, sf: str) -> DataFrame:
    from farwheel.functions import walking

    e = F.col("event_id")
    f = walking.flags(e % 5, F.floor(e / 5) % 4, F.floor(e / 20) % 4, e % 7 == 0)
    return table(spark, sf, "events").select("event_id", F.round(walking.edge_cost(F.col("value"), f), 6).alias("cost"))


@query(
    "SCL-41_tiles",
    """SELECT stop_id, CAST(floor((lon + 180) / 360 * 16384) AS INT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384) AS INT) AS y FROM v_stops""",
)
def tiles(spark: SparkSession, sf: str) -> DataFrame:
    return feed.stops(spark, sf).select("stop_id", geo.tile_x(F.col("lon"), 14).alias("x"), geo.tile_y(F.col("lat"), 14).alias("y"))


@query("SCL-42_flags", "SELECT event_id, CAST((event_id % 4) | ((event_id % 8) << 2) | ((event_id % 2) << 5) AS INT) AS flags, CAST(event_id % 8 AS INT) AS sub FROM events")
def flags(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    f = (e % 4).bitwiseOR(F.shiftleft(e % 8, 2)).bitwiseOR(F.shiftleft(e % 2, 5)).cast("int")
    return table(spark, sf, "events").select("event_id", f.alias("flags"), F.shiftright(f, 2).bitwiseAND(7).alias("sub"))


@query(
    "SCL-44_45_50_progress_heading",
    """SELECT event_id, CAST(floor(least(100.0::DOUBLE, value / 500 * 100)) AS INT) AS percent,
    CASE WHEN event_id % 9 >= 4 THEN event_id % 360 ELSE coalesce(CASE WHEN event_id % 3 = 0 THEN NULL ELSE (event_id + 90) % 360 END, event_id % 360) END AS heading,
    round(value * 4194304 / (78271.51696402048::DOUBLE * cos(radians(45.0::DOUBLE))), 3) AS px FROM events""",
)
def progress_heading(spark: SparkSession, sf: str) -> DataFrame:
    e, v = F.col("event_id"), F.col("value")
    compass = F.when(e % 3 == 0, None).otherwise((e + 90) % 360)
    px = v * feed.d(1 << 22) / (feed.d(78271.51696402048) * F.cos(F.radians(feed.d(45))))
    return table(spark, sf, "events").select("event_id", F.floor(F.least(feed.d(100), v / 500 * 100)).cast("int").alias("percent"), geo.me_heading(e % 9, e % 360, compass).alias("heading"), r3(px).alias("px"))


@query("SCL-46_glide_points", "SELECT event_id, i, round(45.0::DOUBLE + (lat - 45.0::DOUBLE) * i / 6, 9) AS lat FROM v_fixes, (SELECT CAST(i AS INT) AS i FROM range(1, 7) t(i))")
def glide_points(spark: SparkSession, sf: str) -> DataFrame:
    return feed.fixes(spark, sf).select("event_id", "lat", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("i")).select("event_id", "i", F.round(feed.d(45) + (F.col("lat") - feed.d(45)) * F.col("i") / 6, 9).alias("lat"))


@query("SCL-52_clamp_settings", "SELECT event_id, greatest(0.6::DOUBLE, least(2.0::DOUBLE, coalesce(CASE WHEN event_id % 5 = 0 THEN NULL ELSE value / 100 END, 1.2::DOUBLE))) AS speed, CAST(greatest(0, least(5, event_id % 9 - 1)) AS INT) AS transfers FROM events")
def clamp_settings(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    raw = F.to_json(F.struct(F.when(e % 5 == 0, None).otherwise(F.col("value") / 100).alias("speed"), (e % 9 - 1).alias("transfers")))
    s = table(spark, sf, "events").select("event_id", F.from_json(raw, "speed double, transfers int").alias("s"))
    return s.select("event_id", F.greatest(feed.d(0.6), F.least(feed.d(2), F.coalesce("s.speed", feed.d(1.2)))).alias("speed"), F.greatest(F.lit(0), F.least(F.lit(5), "s.transfers")).alias("transfers"))


@query(
    "SCL-60_61_62_63_slices",
    """SELECT trip_id, array_to_string(list_transform(list_sort(list({'p': pos, 's': stop_id}) FILTER (pos BETWEEN 2 AND 5)), lambda x: x.s), ',') AS between_stops,
    min(pos) FILTER (stop_id = 7) AS first_at_7, arg_max(stop_id, pos) AS headsign FROM v_stop_times GROUP BY trip_id""",
)
def slices(spark: SparkSession, sf: str) -> DataFrame:
    s = feed.stop_times(spark, sf).groupBy("trip_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "stop_id"))), lambda x: x["stop_id"]).alias("s"))
    at = F.array_position("s", F.lit(7).cast("bigint")).cast("int")
    return s.select("trip_id", F.array_join(F.transform(F.slice("s", 3, 4), lambda x: x.cast("string")), ",").alias("between_stops"), F.when(at > 0, at - 1).alias("first_at_7"), F.element_at("s", -1).alias("headsign"))


@query("SCL-64_66_json", """SELECT stop_id, name, round(lat, 6) AS lat, round(lon, 6) AS lon FROM v_stops""")
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    point = F.to_json(F.struct(F.lit("Point").alias("type"), F.array(F.round("lon", 6), F.round("lat", 6)).alias("coordinates"), "name"))
    back = F.from_json(point, "type string, coordinates array<double>, name string")
    return feed.stops(spark, sf).select("stop_id", back.alias("p")).select("stop_id", "p.name", F.get("p.coordinates", 1).alias("lat"), F.get("p.coordinates", 0).alias("lon"))


@query(
    "SCL-14_address_line",
    """SELECT c_custkey, coalesce(CASE WHEN st IS NOT NULL THEN st || coalesce(' ' || nr, '') || ', ' || ci ELSE ci END, '') AS address, coalesce(nm, st || coalesce(' ' || nr, ''), ci, '?') AS name FROM (
    SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name END AS nm, CASE WHEN c_custkey % 4 <> 0 THEN 'Via ' || c_custkey % 50 END AS st, CASE WHEN c_custkey % 5 <> 0 THEN CAST(c_custkey % 90 AS VARCHAR) END AS nr, n_name AS ci FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def address_line(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    street, number = F.when(k % 4 != 0, F.concat(F.lit("Via "), (k % 50).cast("string"))), F.when(k % 5 != 0, (k % 90).cast("string"))
    name = F.when(k % 3 == 0, F.col("c_name"))
    return c.select("c_custkey", text.address_line(street, number, F.col("n_name")).alias("address"), text.place_name(name, street, number, F.col("n_name")).alias("name"))


@query(
    "FLT-30_update_due",
    "SELECT event_id, (event_id % 4 = 0) OR (event_id % 7 = 0) OR (event_id * 9000 % 200000) >= 86400 AS due, CASE WHEN NOT (event_id % 4 = 0) AND (event_id % 3 = 0 OR event_id % 2 = 0) THEN 'etag-' || event_id % 11 END AS etag FROM events",
)
def update_due(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of a downloaded file: forced ones, first ones (never checked), or those a day after the last."""
    e = F.col("event_id")
    since = F.when(e % 7 == 0, None).otherwise(e * 9000 % 200000)
    got = times.update_due(since, e % 4 == 0, e % 3 != 0, e % 2 == 0, F.concat(F.lit("etag-"), (e % 11).cast("string")))
    return table(spark, sf, "events").select("event_id", got.alias("u")).select("event_id", "u.due", "u.etag")
