"""Timetable operators: calendars, patterns, boards, headways, delays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOOKBACK, HORIZON, DAY = 1800, 10800, 86400


def service_runs(rows: DataFrame, service_days: DataFrame, day: Column) -> DataFrame:
    """`rows` whose service runs on `day`. The calendar is sent to the rows: services are few, and by them a few tasks would hold all rows."""
    on = F.broadcast(service_days.select(F.col("service_id").alias("__s"), F.col("day").alias("__d")))
    return rows.join(on, (rows["service_id"] == on["__s"]) & (day == on["__d"]), "left_semi")


def calendar_expand(calendar: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(service_id, day) of weekly flags (service_id, days array<boolean> from Monday, start_date, end_date) and
    exceptions (service_id, day, added): the last exception of a day wins."""
    weekly = calendar.select("service_id", "days", F.explode(F.sequence("start_date", "end_date")).alias("day")).where(F.element_at("days", F.weekday("day") + 1)).select("service_id", "day")
    last = exceptions.groupBy("service_id", "day").agg(F.max_by("added", "n").alias("added"))
    both = weekly.withColumn("__in", F.lit(True)).join(last, ["service_id", "day"], "full")
    return both.where(F.coalesce("added", "__in")).select("service_id", "day")


def derive_patterns(stop_times: DataFrame, trips: DataFrame, least: int = 2) -> DataFrame:
    """(route_id, dir, stops, seqs, n_trips, first_trip): trips of one stop sequence; the seqs are the first trip's."""
    per = stop_times.groupBy("trip_id").agg(F.sort_array(F.collect_list(F.struct("seq", "stop_id"))).alias("x")).where(F.size("x") >= least)
    rows = per.join(trips.select("trip_id", "route_id", "dir"), "trip_id").select("trip_id", "route_id", "dir", F.col("x.stop_id").alias("stops"), F.col("x.seq").alias("seqs"))
    return rows.groupBy("route_id", "dir", "stops").agg(F.min_by("seqs", "trip_id").alias("seqs"), F.count("*").alias("n_trips"), F.min("trip_id").alias("first_trip"))


def delay_asof(stop_times: DataFrame, updates: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(trip_id, pos, *keep, delay): the delay of the last update at or before each position, for trips that have updates."""
    keep = keep or []
    last = updates.groupBy("trip_id", "pos").agg(F.max_by("delay", "event_id").alias("delay"))
    known = stop_times.select("trip_id", "pos", *keep).join(last.select("trip_id").distinct(), "trip_id", "left_semi")
    w = Window.partitionBy("trip_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return known.join(last, ["trip_id", "pos"], "left").select("trip_id", "pos", *keep, F.last("delay", ignorenulls=True).over(w).alias("delay")).where("delay is not null")


def unavailable(stop_times: DataFrame, updates: DataFrame) -> DataFrame:
    """(trip_id, pos): all positions of cancelled trips and skipped ones."""
    gone = stop_times.select("trip_id", "pos").join(updates.where("canceled").select("trip_id").distinct(), "trip_id", "left_semi")
    return gone.unionByName(updates.where("skipped").select("trip_id", "pos")).distinct()


def day_offsets(rows: DataFrame, now: int, horizon: int = HORIZON) -> DataFrame:
    """Every row today, yesterday and, where the horizon passes midnight, tomorrow: (day_shift, offset)."""
    shifts = [(0, 0), (-1, -DAY)] + ([(1, DAY)] if now + horizon >= DAY else [])
    both = F.array(*(F.struct(F.lit(a).alias("day_shift"), F.lit(b).alias("offset")) for a, b in shifts))
    return rows.withColumn("__o", F.explode(both)).select("*", "__o.day_shift", "__o.offset").drop("__o")


def departures(stop_times: DataFrame, last_pos: DataFrame, service_days: DataFrame, day: str, now: int, delays: DataFrame | None = None, gone: DataFrame | None = None, horizon: int = HORIZON) -> DataFrame:
    """Departures of all stops expected from `now` on: a late run stays until its expected time."""
    rows = stop_times.join(last_pos, "pattern_id").where("pos < last_pos").drop("last_pos")
    rows = day_offsets(rows, now, horizon).withColumn("scheduled", F.col("dep") + F.col("offset"))
    rows = rows.where(F.col("scheduled").between(now - LOOKBACK, now + horizon))
    rows = service_runs(rows, service_days, F.date_add(F.lit(day).cast("date"), F.col("day_shift")))
    if gone is not None:
        off = gone.select("trip_id", "pos", F.lit(0).alias("day_shift"))
        rows = rows.join(off, ["trip_id", "pos", "day_shift"], "left_anti")
    if delays is not None:
        rows = rows.join(delays, ["trip_id", "pos"], "left")
    else:
        rows = rows.withColumn("delay", F.lit(None).cast("int"))
    return rows.withColumn("expected", F.col("scheduled") + F.coalesce("delay", F.lit(0))).where(F.col("expected") >= now)


def first_n(rows: DataFrame, by: list[str], n: int, *order: Column | str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def headways(first: DataFrame, by: list[str]) -> DataFrame:
    """(by, minutes): the upper middle of the gaps between sorted departures (dep), in whole minutes; null under two."""
    w = Window.partitionBy(*by).orderBy("dep")
    gaps = first.withColumn("gap", F.col("dep") - F.lag("dep").over(w)).groupBy(*by).agg(F.array_sort(F.collect_list("gap")).alias("gaps"))
    mid = F.floor(F.size("gaps") / 2).cast("int") + 1
    return gaps.select(*by, F.when(F.size("gaps") > 0, F.floor(F.get("gaps", mid - 1) / 60)).cast("int").alias("minutes"))


def skyline(rows: DataFrame, by: list[str], *ties: str) -> DataFrame:
    """Rows that none beats weakly on (arr, walk): by walk, those with a strict new least arrival."""
    w = Window.partitionBy(*by).orderBy("walk", "arr", *ties)
    before = F.min("arr").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("__b", before).where("__b is null or arr < __b").drop("__b")
