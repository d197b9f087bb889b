"""GTFS tables from text: a zip's members become text files, lines become rows by header name.

Missing members give empty tables, missing or empty cells null; unknown columns are ignored, in any order."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.functions import text, times


def extract(archive: str, folder: str) -> list[str]:
    """Unpack the text members of a GTFS zip by base name; each is replaced in one step."""
    os.makedirs(folder, exist_ok=True)
    names = []
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            name = os.path.basename(info.filename)
            if name.endswith(".txt"):
                with z.open(info) as f, open(f"{folder}/.{name}", "wb") as out:
                    while chunk := f.read(1 << 20):
                        out.write(chunk)
                os.replace(f"{folder}/.{name}", f"{folder}/{name}")
                names.append(name)
    return names


def read_member(spark: SparkSession, folder: str, member: str, columns: list[str]) -> DataFrame:
    """The wanted columns of a member as strings; an absent member is an empty table."""
    if not os.path.exists(f"{folder}/{member}"):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns))
    rows = spark.read.csv(f"file://{os.path.abspath(folder)}/{member}", header=True, quote='"', escape='"', multiLine=False, encoding="UTF-8")
    have = {c.strip().lstrip("﻿"): c for c in rows.columns}
    cell = lambda c: F.nullif(F.trim(F.col(f"`{have[c]}`")), F.lit("")) if c in have else F.lit(None).cast("string")
    return rows.select(*(cell(c).alias(c) for c in columns))


def parse_lines(lines: DataFrame, header: list[str], wanted: list[str]) -> DataFrame:
    """Rows of a DataFrame of csv lines (line) under a known header. They come of a generator: filters on them aren't pushed below it, where
    each would read the line anew."""
    names = [h.strip().lstrip("﻿") for h in header]
    schema = ", ".join(f"`{n}` string" for n in names)
    r = lines.select(F.inline(F.array(F.from_csv("line", schema, {"quote": '"', "escape": '"'}))))
    return r.select(*((F.nullif(F.col(f"`{c}`"), F.lit("")) if c in names else F.lit(None).cast("string")).alias(c) for c in wanted))


def stops(rows: DataFrame) -> DataFrame:
    """Of (stop_id, stop_code, stop_name, stop_lat, stop_lon, location_type): boarding places with a position."""
    lat, lon = F.col("stop_lat").try_cast("double"), F.col("stop_lon").try_cast("double")
    good = rows.where((F.coalesce("location_type", F.lit("0")) == "0") & F.col("stop_id").isNotNull() & lat.isNotNull() & lon.isNotNull())
    return good.select("stop_id", F.coalesce("stop_code", F.lit("")).alias("code"), text.clean_stop_name(F.coalesce("stop_name", F.lit(""))).alias("name"), lat.alias("lat"), lon.alias("lon"))


def routes(rows: DataFrame) -> DataFrame:
    short = F.coalesce("route_short_name", "route_long_name", "route_id")
    return rows.where("route_id is not null").select("route_id", short.alias("short_name"), F.coalesce("route_long_name", F.lit("")).alias("long_name"), F.coalesce(F.col("route_type").try_cast("int"), F.lit(3)).alias("route_type"))


def calendar(rows: DataFrame) -> DataFrame:
    """(service_id, days from Monday, start_date, end_date)."""
    days = F.array(*(F.coalesce(F.col(d) == "1", F.lit(False)) for d in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")))
    return rows.select("service_id", days.alias("days"), times.parse_date(F.col("start_date")).alias("start_date"), times.parse_date(F.col("end_date")).alias("end_date")).where("service_id is not null and start_date is not null and end_date is not null")


def calendar_dates(rows: DataFrame, order: Column) -> DataFrame:
    """(service_id, day, added): the last row of a service and day."""
    w = Window.partitionBy("service_id", "day").orderBy(F.col("n").desc())
    x = rows.select("service_id", times.parse_date(F.col("date")).alias("day"), (F.col("exception_type") == "1").alias("added"), order.alias("n"))
    return x.withColumn("k", F.row_number().over(w)).where("k = 1 and day is not null").select("service_id", "day", "added")


def trips(rows: DataFrame, known_routes: DataFrame, services: DataFrame) -> DataFrame:
    x = rows.join(known_routes.select("route_id").distinct(), "route_id", "left_semi").join(services.select("service_id").distinct(), "service_id", "left_semi")
    return x.select("trip_id", "route_id", "service_id", F.coalesce(F.col("direction_id").try_cast("int"), F.lit(0)).alias("dir"), "shape_id")


def stop_times(rows: DataFrame, known_trips: DataFrame, known_stops: DataFrame) -> DataFrame:
    """(trip_id, seq, stop_id, dep, arr) of known trips and stops with a sequence and at least one time."""
    # told as numbers first: rows without a time don't travel, and the others are shorter
    told = F.struct(times.parse_gtfs_time(F.col("departure_time")).alias("d"), times.parse_gtfs_time(F.col("arrival_time")).alias("a"))
    x = rows.select("trip_id", F.col("stop_sequence").try_cast("int").alias("seq"), "stop_id", F.inline(F.array(told)))  # once, as in parse_lines
    x = x.where("seq is not null and (d is not null or a is not null)").select("trip_id", "seq", "stop_id", F.coalesce("d", "a").alias("dep"), F.coalesce("a", "d").alias("arr"))
    x = x.join(known_stops.select("stop_id"), "stop_id", "left_semi").join(known_trips.select("trip_id"), "trip_id", "left_semi")
    return x.select("trip_id", "seq", "stop_id", "dep", "arr")


def shapes(rows: DataFrame, needed: DataFrame) -> DataFrame:
    """(shape_id, points array<struct<lat, lon>>) of needed shapes with two points and more."""
    x = rows.join(needed.select("shape_id").distinct(), "shape_id", "left_semi")
    p = F.struct(F.coalesce(F.col("shape_pt_sequence").try_cast("int"), F.lit(0)).alias("seq"), F.col("shape_pt_lat").try_cast("double").alias("lat"), F.col("shape_pt_lon").try_cast("double").alias("lon"))
    g = x.select("shape_id", p.alias("p")).where("p.lat is not null and p.lon is not null").groupBy("shape_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return g.where(F.size("p") > 1).select("shape_id", F.transform("p", lambda q: F.struct(q["lat"].alias("lat"), q["lon"].alias("lon"))).alias("points"))
