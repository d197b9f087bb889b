"""Queries of pedestrian routes over the streets between the feed's stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from farwheel import feed
from farwheel.functions import walking
from farwheel.operators import walkgraph, walks
from farwheel.operators.graph import cut
from farwheel.queries_drawn import _X, _Y, streets
from farwheel.queries_scalars import r3
from farwheel.registry import query


def footways(spark: SparkSession, sf: str) -> DataFrame:
    """The streets on foot: kinds of edges go round by number, and every second row of streets has a name."""
    one = streets(spark, sf).where("edge % 2 = 0")
    k = F.floor(F.col("edge") / 2)
    kind = F.element_at(F.array(*map(F.lit, (walking.PATH, walking.STREET, walking.SIDE, walking.CROSSING, walking.STEPS))), (k % 5 + 1).cast("int"))
    flag = walking.flags(kind, (k % 3).cast("int"), (k % 2).cast("int"), k % 7 == 0)
    name = F.when(k % 4 < 3, F.concat(F.lit("Via "), F.round(F.col("ay")).cast("long").cast("string")))
    flagged = one.select("edge", "a", "b", "ax", "ay", "bx", "by", "metres", flag.alias("flags"), name.alias("name"))
    return flagged.withColumn("cost", walking.edge_cost(F.col("metres"), F.col("flags")))


def asks(spark: SparkSession, sf: str) -> DataFrame:
    """(q, x1, y1, x2, y2): each customer's walk from beside a stop to a place some blocks away."""
    n = feed.table(spark, sf, "supplier").agg(F.count("*").alias("n"))
    c = feed.table(spark, sf, "customer").select(F.col("c_custkey").alias("q")).crossJoin(F.broadcast(n))  # one row
    k, q = F.col("q") % F.col("n"), F.col("q")
    x, y = (k % 32) * F.expr(_X), F.floor(k / 32) * F.expr(_Y)
    return c.select("q", (x + q % 90).alias("x1"), (y + q % 23 - 11).alias("y1"), (x + (q % 4 - 1) * 130.0 + 7).alias("x2"), (y + (q % 3) * 140.0 + 9).alias("y2"))


@query("GRF-13_walk_routes")
def walk_routes(spark: SparkSession, sf: str) -> DataFrame:
    """Each customer's cheapest walk, its pieces in order."""
    found = walks.walk_routes(asks(spark, sf), cut(footways(spark, sf)))
    return found.select("q", "n", "edge", *(r3(c).alias(c) for c in ("ax", "ay", "bx", "by", "cost")), "name")


@query("GRF-14_manoeuvres")
def manoeuvres(spark: SparkSession, sf: str) -> DataFrame:
    """What each walker is told on the way."""
    told = walks.manoeuvres(walks.walk_routes(asks(spark, sf), cut(footways(spark, sf))))
    return told.select("q", "i", "kind", r3("x").alias("x"), r3("y").alias("y"), r3("metres").alias("metres"), "street", "crossing")


@query("GRF-15_reroute")
def reroute(spark: SparkSession, sf: str) -> DataFrame:
    """The way on for walkers who strayed 70 m east and 40 m north of where they began."""
    edges = cut(footways(spark, sf))
    routes = cut(walks.walk_routes(asks(spark, sf), edges))
    strayed = asks(spark, sf).select("q", (F.col("x1") + 70).alias("x"), (F.col("y1") + 40).alias("y"))
    return walks.rerouted(strayed, routes, edges).groupBy("q").agg(F.count("*").alias("pieces"), r3(F.first("cost")).alias("cost"))


@query("GRF-09_walk_graph_build")
def walk_graph_build(spark: SparkSession, sf: str) -> DataFrame:
    """The walking graph of the stops' grid: every row and column is a way, every other row and every third column a busy road."""
    k = F.col("stop_id")
    at = feed.stops(spark, sf).select("stop_id", F.floor(k / 32).alias("row"), (k % 32).alias("column"))
    along = lambda by, i: at.groupBy(by).agg(F.array_sort(F.collect_list("stop_id")).alias("nodes")).withColumnRenamed(by, i)
    rows, columns = along("row", "r"), along("column", "c")
    way = lambda df, n, kind, sided, name: df.select(n.alias("way"), "nodes", kind.cast("int").alias("kind"), (n % 3).cast("int").alias("sub"), sided.alias("sided"), (n % 3).cast("int").alias("left"), F.lit(1).alias("right"), (n % 5 == 0).alias("covered"), name.alias("name"))
    r, c = F.col("r"), F.col("c")
    ways = way(rows, r * 2, F.when(r % 2 == 0, walking.SIDE).otherwise(walking.STREET), r % 2 == 0, F.concat(F.lit("Via "), r))
    ways = ways.unionByName(way(columns, c * 2 + 1, F.when(c % 3 == 0, walking.SIDE).when(c % 3 == 1, walking.STREET).otherwise(walking.PATH), c % 3 == 0, F.when(c % 4 < 3, F.concat(F.lit("Corso "), c))))
    cross = F.when(k % 7 == 0, 0).when(k % 11 == 0, 1).otherwise(-1)
    places = at.select(k.alias("node"), (F.col("column") * F.expr(_X)).alias("x"), (F.col("row") * F.expr(_Y)).alias("y"), cross.alias("cross"))
    return walkgraph.build(cut(ways), cut(places))[1].select("edge", "a", "b", "flags", "name", F.size("geom").alias("points"))
