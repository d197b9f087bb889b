"""A deterministic transit feed over the supplied tables, as DataFrames and as the same views in DuckDB's SQL.

Stops stand on a grid of about 130 m; patterns are shared by all trips of a route and direction; `raw_stop_times` gives
ragged trips of their own. Every literal is DOUBLE, since Spark would make 7.6 a DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: The day and second of day at which queries look, and the rider's place.
DAY, NOW = "2024-01-10", 28800
LAT, LON = 45.0012, 7.6160


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def d(x: float) -> Column:
    return F.lit(float(x)).cast("double")


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    both = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
    return both.select(
        k.alias("stop_id"),
        F.concat(F.lit("Fermata "), k, F.lit(" - "), "n_name").alias("raw_name"),
        F.col("n_name").alias("name"),
        (d(45.0) + F.floor(k / 32) * d(0.0012)).alias("lat"),
        (d(7.6) + (k % 32) * d(0.0016)).alias("lon"),
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(
        k.alias("route_id"),
        (k + 1).cast("string").alias("short_name"),
        F.col("n_name").alias("long_name"),
        F.element_at(F.array(*map(F.lit, (0, 1, 3, 7))), (k % 4 + 1).cast("int")).alias("route_type"),
        F.when(k % 5 == 0, 1).otherwise(0).alias("feed"),
    )


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    route, direction = (F.col("o_custkey") % 25).cast("int"), (k % 2).cast("int")
    return table(spark, sf_dir, "orders").select(
        k.alias("trip_id"),
        route.alias("route_id"),
        direction.alias("dir"),
        (route * 2 + direction).alias("pattern_id"),
        F.col("o_orderpriority").alias("service_id"),
        (18000 + (k * 7919) % 68400).cast("int").alias("base"),
    )


def pattern_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pattern_id, route_id, dir, pos, seq, stop_id, is_last)."""
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    p = spark.range(50).select((F.col("id").cast("int")).alias("pattern_id")).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(7))))
    route, direction = F.floor(F.col("pattern_id") / 2).cast("int"), F.col("pattern_id") % 2
    stop = (route * 7 + F.col("pos") * F.when(direction == 0, 1).otherwise(3)) % F.col("n")
    return p.crossJoin(F.broadcast(n)).select("pattern_id", route.alias("route_id"), direction.alias("dir"), "pos", (F.col("pos") + 1).alias("seq"), stop.cast("bigint").alias("stop_id"), (F.col("pos") == 7).alias("is_last"))


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, pattern_id, route_id, dir, service_id, pos, seq, stop_id, dep, arr): a 400-row pattern table is broadcast."""
    ps = pattern_stops(spark, sf_dir).select("pattern_id", "pos", "seq", "stop_id")
    dep = F.col("base") + 120 * F.col("pos")
    return trips(spark, sf_dir).join(F.broadcast(ps), "pattern_id").select("trip_id", "pattern_id", "route_id", "dir", "service_id", "pos", "seq", "stop_id", dep.alias("dep"), (dep - 20).alias("arr"))


def raw_stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, seq, stop_id): ragged trips."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.row_number().over(w).alias("seq"), F.col("l_suppkey").alias("stop_id"))


def service_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service_id, day)."""
    s = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("service_id")).distinct()
    first = F.lit("2024-01-01").cast("date")
    s = s.withColumn("day", F.explode(F.sequence(first, F.date_add(first, 27))))
    return s.where((F.weekday("day") + F.substring("service_id", 1, 1).cast("int")) % 5 != 0)


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vehicle, ts, lat, lon, kind, value)."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("vehicle"), "ts", (d(45.0) + F.col("value") / 10000).alias("lat"), (d(7.6) + k / d(2000.0)).alias("lon"), F.col("event_type").alias("kind"), "value", k.alias("k"), "event_id")


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(trip_id, pos, delay, canceled, skipped, event_id)."""
    n = table(spark, sf_dir, "orders").agg(F.count("*").alias("n"))
    e = F.col("event_id")
    return table(spark, sf_dir, "events").crossJoin(F.broadcast(n)).select(
        (e % F.col("n")).alias("trip_id"), (e % 8).cast("int").alias("pos"), (F.floor("value") - 100).cast("int").alias("delay"), (e % 17 == 0).alias("canceled"), (e % 11 == 0).alias("skipped"), e.alias("event_id")
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(at, walk_m, ride_m, direct_m, seconds)."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(F.col("ts").alias("at"), v.alias("walk_m"), (v * 10).alias("ride_m"), (v * 1.5).alias("direct_m"), (F.floor(v * 2)).cast("int").alias("seconds"), F.col("user_id").alias("rider"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, header, description, cause, effect, route_id, stop_id, periods): one alert an error event, in force for two hours."""
    e = F.col("event_id")
    start = F.date_trunc("second", "ts")
    n = table(spark, sf_dir, "supplier").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "events").where("event_type = 'error'").crossJoin(F.broadcast(n)).select(
        e.alias("id"),
        F.when(e % 9 == 0, "Sciopero nazionale").otherwise("Avviso").alias("header"),
        F.when(e % 13 == 0, "Possibile agitazione sindacale").otherwise("").alias("description"),
        (e % 12).cast("int").alias("cause"),
        (e % 7).cast("int").alias("effect"),
        (e % 25).cast("int").alias("route_id"),
        (e % F.col("n")).alias("stop_id"),
        start.alias("start"),
        F.when(e % 5 == 0, None).otherwise(start + F.expr("INTERVAL 2 HOURS")).alias("end"),
    )


_V: dict[str, tuple[str, tuple[str, ...]]] = {
    "v_stops": ("""SELECT s_suppkey AS stop_id, 'Fermata ' || s_suppkey || ' - ' || n_name AS raw_name, n_name AS name,
        45.0::DOUBLE + floor(s_suppkey / 32) * 0.0012::DOUBLE AS lat, 7.6::DOUBLE + (s_suppkey % 32) * 0.0016::DOUBLE AS lon
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""", ()),
    "v_routes": ("""SELECT n_nationkey AS route_id, CAST(n_nationkey + 1 AS VARCHAR) AS short_name, n_name AS long_name,
        CAST([0, 1, 3, 7][n_nationkey % 4 + 1] AS INT) AS route_type, CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS feed FROM nation""", ()),
    "v_trips": ("""SELECT o_orderkey AS trip_id, CAST(o_custkey % 25 AS INT) AS route_id, CAST(o_orderkey % 2 AS INT) AS dir,
        CAST((o_custkey % 25) * 2 + o_orderkey % 2 AS INT) AS pattern_id, o_orderpriority AS service_id,
        CAST(18000 + (o_orderkey * 7919) % 68400 AS INT) AS base FROM orders""", ()),
    "v_pattern_stops": ("""SELECT pattern_id, pattern_id // 2 AS route_id, pattern_id % 2 AS dir, pos, pos + 1 AS seq,
        CAST(((pattern_id // 2) * 7 + pos * CASE WHEN pattern_id % 2 = 0 THEN 1 ELSE 3 END) % (SELECT count(*) FROM supplier) AS BIGINT) AS stop_id, pos = 7 AS is_last
        FROM (SELECT CAST(p AS INT) AS pattern_id FROM range(50) t(p)), (SELECT CAST(q AS INT) AS pos FROM range(8) u(q))""", ()),
    "v_stop_times": ("""SELECT t.trip_id, t.pattern_id, t.route_id, t.dir, t.service_id, p.pos, p.seq, p.stop_id, t.base + 120 * p.pos AS dep, t.base + 120 * p.pos - 20 AS arr
        FROM v_trips t JOIN v_pattern_stops p ON t.pattern_id = p.pattern_id""", ("v_trips", "v_pattern_stops")),
    "v_raw_stop_times": ("""SELECT l_orderkey AS trip_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS INT) AS seq,
        l_suppkey AS stop_id FROM lineitem""", ()),
    "v_service_days": ("""SELECT service_id, day FROM (SELECT DISTINCT o_orderpriority AS service_id FROM orders),
        (SELECT CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS day FROM range(28) t(i))
        WHERE (isodow(day) - 1 + CAST(service_id[1] AS INT)) % 5 <> 0""", ()),
    "v_fixes": ("""SELECT user_id AS vehicle, ts, 45.0::DOUBLE + value / 10000 AS lat, 7.6::DOUBLE + CAST(json_extract_string(props, '$.k') AS INT) / 2000.0::DOUBLE AS lon,
        event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INT) AS k, event_id FROM events""", ()),
    "v_updates": ("""SELECT event_id % (SELECT count(*) FROM orders) AS trip_id, CAST(event_id % 8 AS INT) AS pos, CAST(floor(value) - 100 AS INT) AS delay,
        event_id % 17 = 0 AS canceled, event_id % 11 = 0 AS skipped, event_id FROM events""", ()),
    "v_history": ("""SELECT ts AS at, value AS walk_m, value * 10 AS ride_m, value * 1.5::DOUBLE AS direct_m, CAST(floor(value * 2) AS INT) AS seconds, user_id AS rider FROM events""", ()),
    "v_alerts": ("""SELECT event_id AS id, CASE WHEN event_id % 9 = 0 THEN 'Sciopero nazionale' ELSE 'Avviso' END AS header, CASE WHEN event_id % 13 = 0 THEN 'Possibile agitazione sindacale' ELSE '' END AS description, CAST(event_id % 12 AS INT) AS cause,
        CAST(event_id % 7 AS INT) AS effect, CAST(event_id % 25 AS INT) AS route_id, event_id % (SELECT count(*) FROM supplier) AS stop_id, date_trunc('second', ts) AS start,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE date_trunc('second', ts) + INTERVAL 2 HOUR END AS "end" FROM events WHERE event_type = 'error'""", ()),
}


def sql(query: str) -> str:
    """A DuckDB query with the views that it names in front."""
    need: list[str] = []

    def add(name: str) -> None:
        for other in _V[name][1]:
            add(other)
        if name not in need:
            need.append(name)

    for name in _V:
        if name in query:
            add(name)
    query = query.strip()
    if not need:
        return query
    views = ", ".join(f"{v} AS ({_V[v][0]})" for v in need)
    return f"WITH {views}, {query[5:]}" if query.upper().startswith("WITH ") and not query.upper().startswith("WITH RECURSIVE") else (f"WITH RECURSIVE {views}, {query[15:]}" if query.upper().startswith("WITH RECURSIVE") else f"WITH {views} {query}")
