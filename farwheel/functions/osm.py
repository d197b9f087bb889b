"""OpenStreetMap tag rules as Column expressions over a map of tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Highway tags by what may use them.
FOOT = ("footway", "pedestrian", "path", "track")
ROADS = ("residential", "living_street", "service", "unclassified", "tertiary", "secondary", "primary", "trunk", "tertiary_link", "secondary_link", "primary_link")
BUSES = (*ROADS, "motorway", "motorway_link", "trunk_link", "busway", "bus_guideway")


def foot_kind(tags: Column) -> Column:
    """footway, steps or road; null for what can't be walked."""
    h = tags["highway"]
    barred = F.coalesce(tags["foot"].isin("no", "private"), F.lit(False)) | F.coalesce(tags["access"].isin("no", "private"), F.lit(False))
    return F.when(barred, None).when(h == "steps", "steps").when(h.isin(*FOOT), "footway").when(h.isin(*ROADS), "road")


def bus_way(tags: Column) -> Column:
    return F.coalesce(tags["highway"].isin(*BUSES), F.lit(False)) & ~F.coalesce(tags["bus"] == "no", F.lit(False))


def crossing_type(tags: Column) -> Column:
    c = tags["crossing"]
    return F.when(c == "traffic_signals", "signals").when(c.isin("marked", "zebra"), "zebra").when(c == "uncontrolled", "uncontrolled").when(c == "unmarked", "unmarked").otherwise("none")
