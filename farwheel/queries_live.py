"""Queries over riders followed along their journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel import feed
from farwheel.feed import NOW
from farwheel.operators import features, graph, timetable
from farwheel.registry import query
from farwheel.streaming import stats, trips

#: Metres a second of the journeys' rides; with walks at the rules' speed, they give the legs' times.
RIDE_SPEED = 9.0


def routes(spark: SparkSession, sf: str) -> DataFrame:
    """A journey a vehicle, as vertices: a walk of 150 m to a pattern's stop, a ride of three hops (every fifth a metro), a walk on."""
    key = F.col("trip_key")
    at = feed.pattern_stops(spark, sf).join(feed.stops(spark, sf), "stop_id")
    place = lambda pos, lat, lon: at.select("pattern_id", F.col("pos").alias(pos), F.col("lat").alias(lat), F.col("lon").alias(lon))
    j = feed.fixes(spark, sf).select(F.col("vehicle").alias("trip_key")).distinct()
    j = j.select("trip_key", (key % 50).cast("int").alias("pattern_id"), (key % 4).cast("int").alias("from_pos"), (key % 4 + 3).cast("int").alias("to_pos"))
    j = j.join(place("from_pos", "b_lat", "b_lon"), ["pattern_id", "from_pos"]).join(place("to_pos", "a_lat", "a_lon"), ["pattern_id", "to_pos"])
    off = F.lit(0.00135)  # 150 m
    ends = lambda i, kind, la, lo, to_la, to_lo: F.struct(F.lit(i).alias("leg"), F.lit(kind).alias("kind"), la.alias("from_lat"), lo.alias("from_lon"), to_la.alias("to_lat"), to_lo.alias("to_lon"))
    c = F.col
    three = F.array(ends(0, "walk", c("b_lat") - off, c("b_lon"), c("b_lat"), c("b_lon")), ends(1, "ride", c("b_lat"), c("b_lon"), c("a_lat"), c("a_lon")), ends(2, "walk", c("a_lat"), c("a_lon"), c("a_lat") - off, c("a_lon")))
    legs = j.select("trip_key", "pattern_id", "from_pos", "to_pos", F.explode(three).alias("l")).select("trip_key", "pattern_id", "from_pos", "to_pos", "l.*")
    v = features.live_route(legs, feed.pattern_stops(spark, sf), feed.stops(spark, sf)).withColumn("at_stop", F.col("i") > 0)
    return v.withColumn("kind", F.when((F.col("kind") == "ride") & (key % 5 == 0), "metro").otherwise(F.col("kind")))


def times(route: DataFrame) -> DataFrame:
    """(trip_key, leg, departure, arrival) at the legs' speeds."""
    speed = F.when(F.col("kind") == "walk", trips.WALK_SPEED).otherwise(RIDE_SPEED)
    took = route.groupBy("trip_key", "leg").agg(F.max(F.col("along") / speed).alias("took"))
    end = F.sum("took").over(Window.partitionBy("trip_key").orderBy("leg"))
    return took.select("trip_key", "leg", (end - F.col("took")).alias("departure"), end.alias("arrival"))


def rider_events(spark: SparkSession, sf: str, route: DataFrame, leg_times: DataFrame) -> DataFrame:
    """Events of every rider: their fixes laid along the journey at even times, up to 40 m beside it; errors are the vehicle's place, views
    ticks; the plan, and the delay of the run's last update."""
    f = feed.fixes(spark, sf)
    order, every = Window.partitionBy("vehicle").orderBy("ts", "event_id"), Window.partitionBy("vehicle")
    f = f.select(F.col("vehicle").alias("trip_key"), "event_id", "kind", "value", "k", ((F.row_number().over(order) - 0.5) / F.count("*").over(every)).alias("share"))
    whole = leg_times.groupBy("trip_key").agg(F.max("arrival").alias("whole"))
    f = f.join(whole, "trip_key").withColumn("t", F.col("share") * F.col("whole"))
    w = Window.partitionBy("trip_key", "leg").orderBy("i")
    part = lambda a: F.lead(a).over(w)
    s = route.join(leg_times, ["trip_key", "leg"]).withColumn("metres", F.max("along").over(Window.partitionBy("trip_key", "leg")))
    s = s.select("trip_key", "departure", "arrival", "metres", "along", "lat", "lon", part("along").alias("to_along"), part("lat").alias("to_lat"), part("lon").alias("to_lon")).where("to_along is not null")
    clock = lambda m: F.col("departure") + (F.col("arrival") - F.col("departure")) * F.col(m) / F.col("metres")
    s = s.select("trip_key", clock("along").alias("since"), clock("to_along").alias("until"), "lat", "lon", "to_lat", "to_lon")  # a few a trip
    at = (F.col("t") - F.col("since")) / (F.col("until") - F.col("since"))
    beside = (F.floor("value") % 81 - 40) / 111_195.0
    f = f.join(s, "trip_key").where("t >= since and t < until").select(
        "trip_key", "event_id", "t", F.when(F.col("kind") == "error", "vehicle").when(F.col("kind") == "view", "tick").otherwise("fix").alias("what"),
        (F.col("lat") + at * (F.col("to_lat") - F.col("lat")) + beside).alias("lat"), (F.col("lon") + at * (F.col("to_lon") - F.col("lon"))).alias("lon"), (F.col("k") % 60).cast("double").alias("accuracy"),
    )
    start = trips.plans(route, leg_times).withColumns({"event_id": F.lit(-2), "t": F.lit(-1.0), "what": F.lit("start")})
    late = feed.updates(spark, sf).groupBy(F.col("trip_id").alias("trip_key")).agg(F.max_by("delay", "event_id").alias("delay"))
    late = late.join(whole, "trip_key", "left_semi").withColumns({"event_id": F.lit(-1), "t": F.lit(-1.0), "what": F.lit("delay")})
    return trips.events(f, start, late)


@query("STR-07_08_11_live_trip")
def live_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Every rider's state after each fix and tick."""
    route = graph.cut(routes(spark, sf))
    out = trips.follow(rider_events(spark, sf, route, times(route)))
    return out.withColumns({c: F.round(c, 3) for c in ("along", "to_end")})


@query("STR-14_live_stats")
def live_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Every rider in the middle of their events (the timetable's clock is NOW at the journey's start): next vehicles, alighting, arrival."""
    route = graph.cut(routes(spark, sf))
    leg_times = times(route)
    told = graph.cut(rider_events(spark, sf, route, leg_times))
    clock = told.where("what in ('fix', 'tick', 'next')").select("trip_key", "event_id", "t")
    half = clock.groupBy("trip_key").agg((F.max("t") / 2).alias("half"))
    state = trips.follow(told).join(clock, ["trip_key", "event_id"]).join(half, "trip_key")
    now = state.where("t <= half").groupBy("trip_key").agg(F.max(F.struct("t", "event_id", "leg", "to_end", "finished")).alias("x"), F.min(F.when(F.col("leg") == 1, F.col("t"))).alias("boarded")).select("trip_key", "x.*", "boarded")
    metres = route.groupBy("trip_key", "leg").agg(F.max("along").alias("metres")).join(leg_times, ["trip_key", "leg"])
    lengths = metres.groupBy("trip_key").pivot("leg", [0, 1, 2]).agg(F.max("metres").alias("metres"), F.max("arrival").alias("arrival"))  # the three legs
    x = now.join(lengths, "trip_key")
    leg = F.col("leg")
    later = F.when(leg < 1, F.col("1_metres")).otherwise(0.0) + F.when(leg < 2, F.col("2_metres")).otherwise(0.0)
    riders = x.select(
        "trip_key", (F.col("trip_key") % 50).cast("int").alias("pattern_id"), (F.col("trip_key") % 4).cast("int").alias("from_pos"), (F.col("trip_key") % 4 + 3).cast("int").alias("to_pos"),
        F.when(leg == 0, "to_ride").when(leg == 1, "riding").otherwise("done").alias("state"), (NOW + F.when(leg == 1, F.col("boarded")).otherwise(F.col("t"))).alias("at"),
        (F.col("to_end") + later).alias("metres_left"), (F.col("2_arrival") - F.col("1_arrival")).alias("walk_after"), (NOW + F.col("1_arrival")).alias("planned_alight"), (NOW + F.col("2_arrival")).alias("planned_arrival"),
    )
    riders = graph.cut(riders)  # a row a rider, used thrice
    s, u = feed.stop_times(spark, sf), feed.updates(spark, sf)
    out = stats.live_stats(riders, stats.boards(riders, s, timetable.delay_asof(s, u), timetable.unavailable(s, u)))
    return out.withColumns({c: F.round(c, 3) for c in ("metres_left", "alight_at", "arrives")})
