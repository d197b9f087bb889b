"""Queries over polylines: lengths, cuts, turns, coding, drawn networks and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.functions import geo
from farwheel.operators import lines
from farwheel.queries_scalars import r3
from farwheel.registry import query

_XY = """(SELECT s.pattern_id AS line, s.pos AS i, s.stop_id, (a.lon - 7.6::DOUBLE) * 111194.9266::DOUBLE * cos(radians(45.0::DOUBLE)) AS x, (a.lat - 45.0::DOUBLE) * 111194.9266::DOUBLE AS y FROM v_pattern_stops s JOIN v_stops a USING (stop_id))"""
_ALONG = f"""(SELECT *, sum(coalesce(hop, 0)) OVER (PARTITION BY line ORDER BY i) AS along FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS hop FROM {_XY} WINDOW w AS (PARTITION BY line ORDER BY i)))"""


def points(spark: SparkSession, sf: str) -> DataFrame:
    """(line, i, stop_id, x, y): the patterns' stops in plane metres."""
    x, y = geo.plane(F.col("lat"), F.col("lon"), 45.0, 7.6)
    return feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id").select(F.col("pattern_id").cast("bigint").alias("line"), F.col("pos").alias("i"), "stop_id", x.alias("x"), y.alias("y"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r3(c).alias(c) if t == "double" else c for c, t in df.dtypes])


@query("AGG-27_cumulative_metres", f"SELECT CAST(line AS BIGINT) AS line, i, round(along, 3) AS along FROM {_ALONG}")
def cumulative_metres(spark: SparkSession, sf: str) -> DataFrame:
    return lines.measured(points(spark, sf)).select("line", "i", r3("along").alias("along"))


@query(
    "WIN-10_SCL-43_turn_angle",
    f"""SELECT line, i, round(t, 3) AS turn, CASE WHEN abs(t) < 60 THEN 'slight' WHEN abs(t) < 130 THEN 'plain' ELSE 'sharp' END AS class FROM (SELECT CAST(line AS BIGINT) AS line, i, 0 - degrees(atan2(ax * by_ - ay * bx, ax * bx + ay * by_)) AS t FROM (
    SELECT line, i, x - lag(x) OVER w AS ax, y - lag(y) OVER w AS ay, lead(x) OVER w - x AS bx, lead(y) OVER w - y AS by_ FROM {_XY} WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE ax IS NOT NULL AND bx IS NOT NULL) WHERE abs(abs(t) - 180) > 0.000001::DOUBLE""",
)
def turn_angle(spark: SparkSession, sf: str) -> DataFrame:
    """Turns back on itself, whose sign is open, are left to the audits."""
    t = lines.turns(points(spark, sf)).where("abs(abs(turn) - 180) > 0.000001")
    return t.select("line", "i", r3("turn").alias("turn"), geo.turn_class(F.col("turn")).alias("class"))


@query(
    "SCL-48_split_leg",
    f"""WITH a AS (SELECT CAST(line AS BIGINT) AS line, i, x, y, along, CAST((line * 137) % 900 AS DOUBLE) AS cut, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(along) OVER w AS na FROM {_ALONG} WINDOW w AS (PARTITION BY line ORDER BY i)),
    v AS (SELECT line, max(i) AS vi FROM a WHERE along <= cut GROUP BY line),
    e AS (SELECT a.line, vi, coalesce(x + t * (nx - x), x) AS x, coalesce(y + t * (ny - y), y) AS y, nx IS NOT NULL AS inn FROM (SELECT *, CASE WHEN na > along THEN least(1.0::DOUBLE, (cut - along) / (na - along)) ELSE 0.0::DOUBLE END AS t FROM a) a JOIN v ON a.line = v.line AND a.i = v.vi)
    SELECT line, part, CAST(count(*) AS BIGINT) AS n, round(sum(x), 2) AS x, round(sum(y), 2) AS y FROM (
      SELECT a.line, 0 AS part, x, y FROM a JOIN v ON a.line = v.line AND i <= vi UNION ALL SELECT line, 0, x, y FROM e WHERE inn UNION ALL SELECT line, 1, x, y FROM e UNION ALL SELECT a.line, 1, x, y FROM a JOIN v ON a.line = v.line AND i > vi) GROUP BY line, part""",
)
def split_leg(spark: SparkSession, sf: str) -> DataFrame:
    p = points(spark, sf).drop("stop_id")
    cuts = p.select("line").distinct().withColumn("cut", (F.col("line") * 137 % 900).cast("double"))
    return lines.split_at(p, cuts).groupBy("line", "part").agg(F.count("*").alias("n"), F.round(F.sum("x"), 2).alias("x"), F.round(F.sum("y"), 2).alias("y"))


@query("SCL-49_douglas_peucker")
def douglas_peucker(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(lines.simplified(points(spark, sf).drop("stop_id"), 20.0))


@query(
    "SCL-65_varint_zigzag",
    f"""SELECT line, i, delta, z, lower(printf('%02x', (z & 127) | CASE WHEN z >= 128 THEN 128 ELSE 0 END) || CASE WHEN z >= 128 THEN printf('%02x', ((z >> 7) & 127) | CASE WHEN z >= 16384 THEN 128 ELSE 0 END) ELSE '' END || CASE WHEN z >= 16384 THEN printf('%02x', ((z >> 14) & 127) | CASE WHEN z >= 2097152 THEN 128 ELSE 0 END) ELSE '' END
    || CASE WHEN z >= 2097152 THEN printf('%02x', ((z >> 21) & 127) | CASE WHEN z >= 268435456 THEN 128 ELSE 0 END) ELSE '' END || CASE WHEN z >= 268435456 THEN printf('%02x', (z >> 28) & 127) ELSE '' END) AS bytes, delta AS back
    FROM (SELECT *, CASE WHEN delta < 0 THEN -2 * delta - 1 ELSE 2 * delta END AS z FROM (SELECT CAST(pattern_id AS BIGINT) AS line, pos AS i, e5 - coalesce(lag(e5) OVER (PARTITION BY pattern_id ORDER BY pos), 0) AS delta FROM (SELECT pattern_id, pos, CAST(round(lat * 100000) AS BIGINT) AS e5 FROM v_pattern_stops JOIN v_stops USING (stop_id))))""",
)
def varint_zigzag(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("line").orderBy("i")
    p = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id").select(F.col("pattern_id").cast("bigint").alias("line"), F.col("pos").alias("i"), geo.fixed(F.col("lat"), 100_000).cast("bigint").alias("e5"))
    p = p.withColumn("delta", F.col("e5") - F.coalesce(F.lag("e5").over(w), F.lit(0))).withColumn("z", lines.zigzag(F.col("delta")))
    return p.select("line", "i", "delta", "z", F.lower(lines.varint_hex(F.col("z"))).alias("bytes"), lines.unzigzag(F.col("z")).alias("back"))


@query("WIN-15_keep_local_minima")
def keep_local_minima(spark: SparkSession, sf: str) -> DataFrame:
    """Of each stop's places on the lines within 150 m, one for each 30 m along a line."""
    p = points(spark, sf)
    seg = lines.segments(p.drop("stop_id")).join(lines.measured(p).select("line", "i", "along"), ["line", "i"])
    x, y = geo.plane(F.col("lat"), F.col("lon"), 45.0, 7.6)
    near = feed.stops(spark, sf).select("stop_id", x.alias("px"), y.alias("py"), F.floor(x / 150).cast("int").alias("cx"), F.floor(y / 150).cast("int").alias("cy"))
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - 150) / 150).cast("int"), F.floor((hi + 150) / 150).cast("int")))
    seg = seg.withColumn("cx", spread(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("cy", spread(F.least("ay", "by"), F.greatest("ay", "by")))
    on = near.join(seg, ["cx", "cy"]).withColumn("on", geo.project(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))).where("on.metres <= 150")
    pos = F.col("along") - (1 - F.col("on.t")) * F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))
    per = on.groupBy("stop_id", "line").agg(F.sort_array(F.collect_list(F.struct(F.round(pos, 3).alias("pos"), F.round("on.metres", 3).alias("dist")))).alias("all"))
    return per.select("stop_id", "line", F.explode(lines.local_minima(F.col("all"))).alias("c")).select("stop_id", "line", "c.pos", "c.dist")


@query(
    "SET-04_covered_contains_all",
    """WITH p AS (SELECT pattern_id, route_id, dir, count(DISTINCT stop_id) AS n, list(DISTINCT stop_id) AS s FROM v_pattern_stops GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY route_id ORDER BY n DESC, pattern_id) AS k FROM p)
    SELECT CAST(a.route_id AS BIGINT) AS owner, CAST(a.pattern_id AS BIGINT) AS line FROM k a WHERE k = 1 OR EXISTS (SELECT 1 FROM k b WHERE b.route_id = a.route_id AND b.k = 1 AND NOT list_has_all(b.s, a.s))""",
)
def covered_contains_all(spark: SparkSession, sf: str) -> DataFrame:
    p = feed.pattern_stops(spark, sf).groupBy(F.col("route_id").cast("bigint").alias("owner"), F.col("pattern_id").cast("bigint").alias("line")).agg(F.collect_set("stop_id").alias("stops"))
    return lines.longest_first(p.withColumn("size", F.size("stops")))


_CHORD = f"""c AS (SELECT line, arg_min(x, i) AS ax, arg_min(y, i) AS ay, arg_max(x, i) AS bx, arg_max(y, i) AS by_ FROM {_XY} GROUP BY line),
    s AS (SELECT stop_id, x, y, ax, ay, bx, by_, CASE WHEN l > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / l)) ELSE 0.0::DOUBLE END AS t FROM (SELECT *, pow(bx - ax, 2) + pow(by_ - ay, 2) AS l FROM {_XY} JOIN c USING (line))),
    d AS (SELECT stop_id, x, y, ax + t * (bx - ax) AS sx, ay + t * (by_ - ay) AS sy FROM s)"""


@query("SNK-05_connectors", f"WITH {_CHORD} SELECT stop_id, count(*) AS n FROM (SELECT DISTINCT stop_id, round(sx) AS kx, round(sy) AS ky FROM d WHERE sqrt(pow(x - sx, 2) + pow(y - sy, 2)) >= 3) GROUP BY stop_id")
def connectors(spark: SparkSession, sf: str) -> DataFrame:
    """Stops whose patterns are drawn as straight lines from first to last stop; how many connectors each has."""
    p = points(spark, sf)
    ends = p.groupBy("line").agg(F.min(F.struct("i", "x", "y")).alias("a"), F.max(F.struct("i", "x", "y")).alias("b"))
    t = geo.project(F.col("x"), F.col("y"), F.col("a.x"), F.col("a.y"), F.col("b.x"), F.col("b.y"))["t"]
    snapped = p.join(ends, "line").withColumn("t", t).select("stop_id", (F.col("a.x") + F.col("t") * (F.col("b.x") - F.col("a.x"))).alias("x"), (F.col("a.y") + F.col("t") * (F.col("b.y") - F.col("a.y"))).alias("y"))
    found = lines.connectors(p.select("stop_id", "x", "y").distinct(), snapped)
    return found.groupBy("stop_id").agg(F.count("*").alias("n"))


@query(
    "GRF-27_knots",
    f"""WITH p AS {_ALONG}, j AS (SELECT DISTINCT round(x) AS jx, round(y) AS jy FROM p WHERE i IN (0, 7)),
    s AS (SELECT *, lag(x) OVER w AS ax, lag(y) OVER w AS ay FROM p WINDOW w AS (PARTITION BY line ORDER BY i)),
    k AS (SELECT a.line, a.i, b.i AS j, a.ax, a.ay, a.x AS bx, a.y AS by_, b.ax AS cx, b.ay AS cy, b.x AS dx, b.y AS dy FROM s a JOIN s b ON a.line = b.line AND b.i >= a.i + 2 AND b.along - b.hop - a.along <= 2000 WHERE a.ax IS NOT NULL),
    f AS (SELECT line, i, x, y, before, after, abs(degrees(atan2(ux * vy - uy * vx, ux * vx + uy * vy))) AS t FROM (SELECT line, i, x, y, ux, uy, vx, vy, sqrt(ux * ux + uy * uy) AS before, sqrt(vx * vx + vy * vy) AS after FROM (SELECT line, i, x, y, x - lag(x) OVER w AS ux, y - lag(y) OVER w AS uy, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM p WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE ux IS NOT NULL AND vx IS NOT NULL))
    SELECT CAST(line AS BIGINT) AS line, i, 'cross' AS kind FROM k WHERE ((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) * ((bx - ax) * (dy - ay) - (by_ - ay) * (dx - ax)) < 0 AND ((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * ((dx - cx) * (by_ - cy) - (dy - cy) * (bx - cx)) < 0
      AND NOT EXISTS (SELECT 1 FROM p q JOIN j ON round(q.x) = jx AND round(q.y) = jy WHERE q.line = k.line AND q.i >= k.i AND q.i < k.j)
    UNION ALL SELECT CAST(line AS BIGINT), i, 'fold' FROM f WHERE least(before, after) >= 2 AND greatest(before, after) <= 5000 AND t > 150 AND NOT EXISTS (SELECT 1 FROM j WHERE round(f.x) = jx AND round(f.y) = jy)""",
)
def knots(spark: SparkSession, sf: str) -> DataFrame:
    """Over the patterns, whose hops are hundreds of metres: legs of a fold up to 5 km, loops up to 2 km."""
    p = points(spark, sf).drop("stop_id")
    cross = lines.self_crossings(p, 2000.0).select("line", "i", F.lit("cross").alias("kind"))
    return cross.unionByName(lines.folds(p, most=5000.0).select("line", "i", F.lit("fold").alias("kind")))


def drawn(spark: SparkSession, sf: str) -> DataFrame:
    """The first five stops of every second pattern, as drawn lines: a network with holes."""
    return points(spark, sf).where("line % 2 = 0 and i < 5").drop("stop_id")


@query("JN-27_28_GRF-28_gaps")
def gaps(spark: SparkSession, sf: str) -> DataFrame:
    return lines.gaps(points(spark, sf).drop("stop_id"), drawn(spark, sf))


@query(
    "JN-27_near_lines",
    f"""WITH p AS {_XY}, d AS (SELECT * FROM (SELECT line, i, lag(x) OVER w AS ax, lag(y) OVER w AS ay, x AS bx, y AS by_ FROM p WHERE line % 2 = 0 AND i < 5 WINDOW w AS (PARTITION BY line ORDER BY i)) WHERE ax IS NOT NULL),
    m AS (SELECT v.line, v.i, d.line AS drawn FROM (SELECT *, CASE WHEN l > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / l)) ELSE 0.0::DOUBLE END AS t FROM (SELECT p.line, p.i, p.x, p.y, d.line AS dl, ax, ay, bx, by_, pow(bx - ax, 2) + pow(by_ - ay, 2) AS l FROM p, d)) v JOIN (SELECT DISTINCT line FROM d) d ON v.dl = d.line WHERE sqrt(pow(x - ax - t * (bx - ax), 2) + pow(y - ay - t * (by_ - ay), 2)) <= 1)
    SELECT CAST(p.line AS BIGINT) AS line, p.i, coalesce(string_agg(DISTINCT CAST(drawn AS VARCHAR), ',' ORDER BY CAST(drawn AS VARCHAR)), '') AS near FROM p LEFT JOIN m ON p.line = m.line AND p.i = m.i GROUP BY p.line, p.i""",
)
def near_lines(spark: SparkSession, sf: str) -> DataFrame:
    n = lines.near_lines(points(spark, sf).drop("stop_id"), drawn(spark, sf))
    return n.select("line", "i", F.array_join(F.array_sort(F.transform("near", lambda x: x.cast("string"))), ",").alias("near"))
