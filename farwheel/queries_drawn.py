"""Queries of map matching: streets between the feed's stops, and tracks of customers drawn along them and off them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.operators import features, lines, snapping
from farwheel.operators.graph import cut
from farwheel.queries_lines import points
from farwheel.queries_scalars import r3
from farwheel.registry import query

#: A block of the stops' grid in plane metres, DOUBLE: all that is reckoned with decimals is slow.
_X, _Y = "0.0016 * 111194.9266 * cos(radians(45.0))", "CAST(0.0012 * 111194.9266 AS DOUBLE)"


def streets(spark: SparkSession, sf: str) -> DataFrame:
    """Roads between stops that are neighbours on the grid. Some blocks have none, some a street that bends 60 m away and back, some are
    service roads; every third row is a one-way street, whose other way is dear. A second carriageway for the other way lies 18 m off some. Some
    break off at a yard of 66 m, which a road 40 m off goes round: a gap that only a bridge fills, where the track is near enough."""
    k = F.col("stop_id")
    at = feed.stops(spark, sf).select("stop_id", (k % 32 * F.expr(_X)).alias("x"), (F.floor(k / 32) * F.expr(_Y)).alias("y"))
    to = at.select(F.col("stop_id").alias("to_id"), F.col("x").alias("bx"), F.col("y").alias("by"))
    east = at.where(k % 32 < 31).withColumn("to_id", k + 1)
    north = at.withColumn("to_id", k + 32)
    both = east.unionByName(north).join(to, "to_id").select("stop_id", "to_id", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by").where((k + F.col("to_id")) % 11 != 4)
    eastward = F.col("to_id") == k + 1
    block = k * 2 + F.when(eastward, 0).otherwise(1)
    way = block * 4
    bend = (k + F.col("to_id")) % 13 == 7
    yard = eastward & (k % 11 == 8)  # no street goes north there, whose first number is the yard's fifth
    dual = (k + F.col("to_id")) % 9 == 2
    middle = -block - 1
    node = lambda j: F.lit(-(1 << 40)) - block * 4 - j
    mx, my = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2 + 60
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    oneway = F.floor(k / 32) % 3 == 1
    dear = lambda wrong: F.when(wrong, 3.0).otherwise(0.0)

    def piece(i: int, a: Column, b: Column, ax: Column, ay: Column, bx: Column, by: Column, ahead: Column = F.lit(False), back: Column = oneway) -> Column:
        at = zip(("a", "b", "ax", "ay", "bx", "by"), (a, b, ax, ay, bx, by), strict=True)
        return F.struct((way + i).alias("way"), *(c.alias(n) for n, c in at), dear(ahead).alias("ahead"), dear(back).alias("back"))

    m = [(ax + 30, ay), (ax + 22, ay + 40), (ax + 104, ay + 40), (ax + 96, ay)]
    round_ = [(k, (ax, ay)), *((node(j), m[j]) for j in range(4)), (F.col("to_id"), (bx, by))]
    broken = F.array(*(piece(i, p, q, *u, *v) for i, ((p, u), (q, v)) in enumerate(zip(round_, round_[1:]))))
    ox, oy = F.when(eastward, 0.0).otherwise(18.0), F.when(eastward, -18.0).otherwise(0.0)
    never, always = F.lit(False), F.lit(True)
    other = [piece(1, k, node(0), ax, ay, ax + ox, ay + oy, never, never), piece(2, node(0), node(1), ax + ox, ay + oy, bx + ox, by + oy, always, never), piece(3, node(1), F.col("to_id"), bx + ox, by + oy, bx, by, never, never)]
    two = F.array(piece(0, k, F.col("to_id"), ax, ay, bx, by, never, always), *other)
    bent = F.array(piece(0, k, middle, ax, ay, mx, my), piece(1, middle, F.col("to_id"), mx, my, bx, by))
    parts = F.when(bend, bent).when(yard, broken).when(dual, two).otherwise(F.array(piece(0, k, F.col("to_id"), ax, ay, bx, by)))
    one = both.select(F.explode(parts).alias("p"), (k % 17 == 3).alias("service")).select("p.*", "service")
    ahead = one.select((F.col("way") * 2).alias("edge"), "a", "b", "ax", "ay", "bx", "by", F.col("ahead").alias("contra"), "service")
    back = one.select((F.col("way") * 2 + 1).alias("edge"), F.col("b").alias("a"), F.col("a").alias("b"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"), F.col("back").alias("contra"), "service")
    roads = ahead.unionByName(back)
    return roads.select("edge", "a", "b", "ax", "ay", "bx", "by", F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("metres"), (F.col("contra") + F.when(F.col("service"), 1.0).otherwise(0.0)).alias("penalty"), "service")


def tracks(spark: SparkSession, sf: str) -> DataFrame:
    """(line, i, x, y): a track of each customer from a stop on, some blocks east, north, east or back again, some metres off the street."""
    n = feed.table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    c = feed.table(spark, sf, "customer").select(F.col("c_custkey").alias("line")).crossJoin(F.broadcast(n))  # one row
    k, line = F.col("line") % F.col("n"), F.col("line")
    x0, y0 = k % 32, F.floor(k / 32)
    e, u = line % 3 + 1, F.floor(line / 3) % 2 + 1
    corner = lambda i, x, y: F.struct(F.lit(i).cast("long").alias("i"), (x * F.expr(_X)).alias("x"), (y * F.expr(_Y) + line % 7 * 2 - 6).alias("y"))
    turned = F.when(line % 5 == 0, x0).otherwise(x0 + e + 1)
    return c.select("line", F.explode(F.array(corner(0, x0 + 0.1, y0), corner(1, x0 + e, y0), corner(2, x0 + e, y0 + u), corner(3, turned, y0 + u))).alias("p")).select("line", "p.*")


def riders_stops(shapes: DataFrame) -> DataFrame:
    """(line, stop, x, y): stops of each track, 4 m beside it, every 90 m."""
    s = lines.resample(shapes, 90.0)
    return s.select("line", F.col("k").alias("stop"), (F.col("x") + 2).alias("x"), (F.col("y") - 4).alias("y"))


def _stages(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    roads, shapes = cut(streets(spark, sf)), tracks(spark, sf)
    at = snapping.samples(shapes)
    near = cut(snapping.short_routes(roads, roads))  # from all ends of roads, so candidates are read once and need no copy
    match = snapping.match(at, roads, near)
    drawn = snapping.run_edges(match, near, roads)
    return {"roads": roads, "shapes": shapes, "at": at, "match": match, "drawn": drawn}


def _bridged(s: dict[str, DataFrame]) -> DataFrame:
    return snapping.bridges(snapping.run_gaps(s["match"], s["drawn"], s["roads"]), s["at"], s["shapes"], s["roads"])


def _path(s: dict[str, DataFrame]) -> DataFrame:
    return snapping.assembled(s["at"], s["match"], s["drawn"], _bridged(s), s["roads"])


@query(
    "WIN-14_resample_15m",
    """WITH p AS (SELECT s.pattern_id AS line, s.pos AS i, (a.lon - 7.6::DOUBLE) * 111194.9266::DOUBLE * cos(radians(45.0::DOUBLE)) AS x, (a.lat - 45.0::DOUBLE) * 111194.9266::DOUBLE AS y FROM v_pattern_stops s JOIN v_stops a USING (stop_id)),
    m AS (SELECT *, sum(coalesce(hop, 0)) OVER (PARTITION BY line ORDER BY i) AS along FROM (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS hop FROM p WINDOW w AS (PARTITION BY line ORDER BY i))),
    h AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(along) OVER w AS na FROM m WINDOW w AS (PARTITION BY line ORDER BY i)),
    g AS (SELECT line, k, x + (k * 15 - along) / (na - along) * (nx - x) AS x, y + (k * 15 - along) / (na - along) * (ny - y) AS y, k * 15.0::DOUBLE AS along FROM (SELECT *, unnest(range(CAST(floor(along / 15) AS BIGINT) + 1, CAST(floor(na / 15) AS BIGINT) + 1)) AS k FROM h WHERE na > along)),
    e AS (SELECT line, arg_max(x, i) AS x, arg_max(y, i) AS y, max(along) AS along, arg_min(x, i) AS x0, arg_min(y, i) AS y0 FROM m GROUP BY line)
    SELECT CAST(line AS BIGINT) AS line, count(*) AS n, round(sum(x), 3) AS x, round(sum(y), 3) AS y, round(max(along), 3) AS along FROM (
      SELECT * FROM g UNION ALL SELECT line, 0, x0, y0, 0.0::DOUBLE FROM e UNION ALL SELECT line, CAST(floor(along / 15) AS BIGINT) + 1, x, y, along FROM e WHERE along - floor(along / 15) * 15 > 1) GROUP BY line""",
)
def resample_15m(spark: SparkSession, sf: str) -> DataFrame:
    """Samples every 15 m along each pattern."""
    s = lines.resample(points(spark, sf).drop("stop_id"), 15.0)
    return s.groupBy("line").agg(F.count("*").alias("n"), r3(F.sum("x")).alias("x"), r3(F.sum("y")).alias("y"), r3(F.max("along")).alias("along"))


@query("GRF-16_map_match")
def map_match(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest road edge of each sample of each track, in runs."""
    return _stages(spark, sf)["match"].select("line", "run", "k", "edge", F.round("t", 6).alias("t"))


@query("GRF-17_gap_bridge")
def gap_bridge(spark: SparkSession, sf: str) -> DataFrame:
    """Each gap between runs with the route that fills it, or why none does."""
    return _bridged(_stages(spark, sf))


@query("GRF-18_collapse_spurs")
def collapse_spurs(spark: SparkSession, sf: str) -> DataFrame:
    """How many vertices and metres each path has before and after its spurs go."""
    s = _stages(spark, sf)
    path = _path(s)
    size = lambda p, name: lines.measured(p).groupBy("line").agg(F.count("*").alias(f"n_{name}"), r3(F.max("along")).alias(f"m_{name}"))
    return size(path, "before").join(size(snapping.collapsed(path, s["roads"], s["shapes"]), "after"), "line")


@query("GRF-19_stop_chain")
def stop_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Tracks drawn from their stops alone."""
    return snapping.stop_chain(riders_stops(tracks(spark, sf)), cut(streets(spark, sf))).select("line", "i", r3("x").alias("x"), r3("y").alias("y"), "edge")


@query("GRF-20_place_stops")
def place_stops(spark: SparkSession, sf: str) -> DataFrame:
    """Where each track's stops stand on its shape."""
    shapes = tracks(spark, sf)
    return snapping.placed(shapes, riders_stops(shapes)).withColumn("offset", r3("offset"))


@query("GRF-21_finish_path")
def finish_path(spark: SparkSession, sf: str) -> DataFrame:
    """Each hop between stops of the matched and cleaned paths, and whether it touches a marked stretch."""
    s = _stages(spark, sf)
    path = snapping.collapsed(_path(s), s["roads"], s["shapes"])
    return snapping.finished(path, snapping.placed(path, riders_stops(s["shapes"])))[1]


@query("GRF-23_chains")
def drawn_chains(spark: SparkSession, sf: str) -> DataFrame:
    """The network of all runs as it is drawn: maximal chains of one mode, route set and direction count, with their points in order.

    A hop is what a run of the raw stop times drives between two of its stops that are neighbours on the grid."""
    w = Window.partitionBy("trip_id").orderBy("seq")
    hops = feed.raw_stop_times(spark, sf).withColumn("to_node", F.lead("stop_id").over(w)).where("abs(to_node - stop_id) in (1, 2, 32)")
    routes = feed.trips(spark, sf).select("trip_id", "route_id").join(feed.routes(spark, sf).select("route_id", "route_type"), "route_id")
    one = hops.join(routes, "trip_id").select(F.col("route_type").alias("mode"), F.col("stop_id").alias("from_node"), "to_node", (F.col("route_id") % 3).cast("string").alias("route")).distinct()
    return features.chain_features(one, feed.stops(spark, sf).select(F.col("stop_id").alias("node"), "lat", "lon"))
