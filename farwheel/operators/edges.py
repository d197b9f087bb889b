"""Segments near points, in plane metres."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.functions import geo


def pattern_segments(pattern_stops: DataFrame, stops: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """(pattern_id, pos, ax, ay, bx, by): the straight hops of patterns that go anywhere."""
    x, y = geo.plane(F.col("lat"), F.col("lon"), lat0, lon0)
    at = pattern_stops.select("pattern_id", "pos", "stop_id").join(stops.select("stop_id", x.alias("x"), y.alias("y")), "stop_id")
    w = Window.partitionBy("pattern_id").orderBy("pos")
    hops = at.select("pattern_id", "pos", "stop_id", F.lead("stop_id").over(w).alias("next"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.lead("x").over(w).alias("bx"), F.lead("y").over(w).alias("by"))
    return hops.where("next is not null and next <> stop_id").drop("stop_id", "next")


def nearest_edges(points: DataFrame, by: str, segments: DataFrame, key: list[str], radius: float, slack: float, most: int) -> DataFrame:
    """(by, key, metres): the `most` nearest segments (ax, ay, bx, by) of each point (px, py) within the radius and within
    `slack` metres of the nearest. A segment is spread over the cells that its box, padded by the radius, touches."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - radius) / radius).cast("int"), F.floor((hi + radius) / radius).cast("int")))
    s = segments.withColumn("cx", spread(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("cy", spread(F.least("ay", "by"), F.greatest("ay", "by")))
    p = points.withColumn("cx", F.floor(F.col("px") / radius).cast("int")).withColumn("cy", F.floor(F.col("py") / radius).cast("int"))
    metres = geo.project(*(F.col(c) for c in ("px", "py", "ax", "ay", "bx", "by")))["metres"]
    near = p.join(s, ["cx", "cy"]).withColumn("metres", metres).where(F.col("metres") <= radius).select(by, *key, "metres")
    w = Window.partitionBy(by)
    ranked = near.withColumn("best", F.min("metres").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.round("metres", 6), *key)))
    return ranked.where((F.col("k") <= most) & (F.col("metres") <= F.col("best") + slack)).select(by, *key, "metres")
