"""Drawn features: merged segments of a network as GeoJSON, and a journey flattened to polylines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.functions import geo, text
from farwheel.operators import graph


def segment_features(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, draw_rank, feature) of hops (mode, from_node, to_node, route, tier) and nodes (node, lat, lon).

    Both ways of a hop are one feature with all its routes, their least tier, an arrow where it runs one way only and a shade where
    one route runs. Ends that are drawn at one place make no line."""
    way = F.col("from_node") <= F.col("to_node")
    seg = hops.groupBy("mode", F.least("from_node", "to_node").alias("a"), F.greatest("from_node", "to_node").alias("b")).agg(
        F.array_sort(F.collect_set("route")).alias("routes"), F.min("tier").alias("tier"), F.bool_or(way).alias("ahead"), F.bool_or(~way).alias("back")
    )
    at = lambda k: nodes.select(F.col("node").alias(k), F.array(F.round("lon", 6), F.round("lat", 6)).alias(f"at_{k}"))
    placed = seg.join(at("a"), "a").join(at("b"), "b").where("at_a <> at_b")
    one = F.size("routes") == 1
    properties = F.struct(
        text.mode_key(F.col("mode")).alias("mode"), F.array_join("routes", ",").alias("routes"), F.size("routes").alias("n"), "tier",
        F.when(F.col("ahead") & F.col("back"), 0).otherwise(1).alias("arrow"), F.when(one, text.shade_of(F.get("routes", F.lit(0)))).otherwise(-1).alias("shade"),
    )
    line = F.struct(F.lit("LineString").alias("type"), F.array("at_a", "at_b").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), line.alias("geometry"), properties.alias("properties")))
    return placed.select("a", "b", text.draw_rank(F.col("mode")).alias("draw_rank"), feature.alias("feature"))


def chain_features(hops: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chain, mode, routes, one_way, n, line) of hops (mode, from_node, to_node, route) and nodes (node, lat, lon): the drawn network. Hops
    between the same nodes are one segment with all its routes; segments of one mode, route set and count of directions are chained
    where nothing else of theirs meets, one-way chains in the direction of travel. `line` is GeoJSON."""
    way = F.col("from_node") <= F.col("to_node")
    seg = hops.where("from_node <> to_node").groupBy("mode", F.least("from_node", "to_node").alias("x"), F.greatest("from_node", "to_node").alias("y")).agg(F.array_sort(F.collect_set("route")).alias("routes"), F.bool_or(way).alias("ahead"), F.bool_or(~way).alias("back"))
    one = F.col("ahead") != F.col("back")
    turned = one & F.col("back")
    seg = seg.select("mode", "routes", one.alias("oneway"), F.when(turned, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(turned, F.col("x")).otherwise(F.col("y")).alias("b"))
    seg = graph.cut(graph.ordinals(seg, ["mode", "a", "b", "oneway"], "id").withColumn("key", F.concat_ws("|", "mode", F.array_join("routes", ","))))
    order = graph.cut(graph.chains(seg))
    at = nodes.select("node", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
    place = lambda k: at.select(F.col("node").alias(k), F.array("lon", "lat").alias(f"at_{k}"))
    drawn = order.join(seg, "id").join(place("a"), "a").join(place("b"), "b")
    pair = F.when(F.col("forward"), F.struct("pos", F.col("at_a").alias("p"), F.col("at_b").alias("q"))).otherwise(F.struct("pos", F.col("at_b").alias("p"), F.col("at_a").alias("q")))
    per = drawn.groupBy("chain").agg(F.first("mode").alias("mode"), F.first("routes").alias("routes"), F.first("oneway").alias("one_way"), F.sort_array(F.collect_list(pair)).alias("s"))  # of one chain: its own points
    points = F.concat(F.array(F.col("s")[0]["p"]), F.transform("s", lambda x: x["q"]))
    line = F.to_json(F.struct(F.lit("LineString").alias("type"), points.alias("coordinates")))
    return per.select("chain", text.mode_key(F.col("mode")).alias("mode"), F.array_join("routes", ",").alias("routes"), "one_way", F.size("s").alias("n"), line.alias("line"))


def live_route(legs: DataFrame, pattern_stops: DataFrame, stops: DataFrame) -> DataFrame:
    """(trip_key, leg, kind, i, lat, lon, along): each leg's polyline with the metres from its start.

    Legs are (trip_key, leg, kind, pattern_id, from_pos, to_pos, from_lat, from_lon, to_lat, to_lon): a 'ride' follows its pattern's
    stops from one position to the other, any other leg is straight. Two equal places in a row are one vertex."""
    ride = F.col("kind") == "ride"
    at = pattern_stops.join(stops.select("stop_id", "lat", "lon"), "stop_id").select("pattern_id", "pos", "lat", "lon")
    rides = legs.where(ride).select("trip_key", "leg", "kind", "pattern_id", "from_pos", "to_pos").join(at, "pattern_id").where("pos between from_pos and to_pos")
    ends = F.array(F.struct(F.lit(0).alias("i"), F.col("from_lat").alias("lat"), F.col("from_lon").alias("lon")), F.struct(F.lit(1).alias("i"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")))
    walks = legs.where(~ride).select("trip_key", "leg", "kind", F.explode(ends).alias("p")).select("trip_key", "leg", "kind", "p.*")
    every = rides.select("trip_key", "leg", "kind", (F.col("pos") - F.col("from_pos")).alias("i"), "lat", "lon").unionByName(walks)
    w = Window.partitionBy("trip_key", "leg").orderBy("i")
    hop = geo.haversine(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"))
    met = every.withColumn("__hop", F.when(F.lag("lat").over(w).isNotNull(), hop)).where("__hop is null or __hop > 0")
    return met.withColumn("along", F.sum(F.coalesce("__hop", F.lit(0.0))).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__hop")
