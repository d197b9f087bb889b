"""What a rider is told on the way: the next two vehicles, when to alight, when they arrive, metres left; what became of a finished trip.

Riders meet runs by time in windows over (pattern, board, alight), not in pairs: each rider sees the run before and the one after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Seconds: a rider is on the run whose departure is nearest to when they boarded, if it is within this.
BOARDED_WITHIN = 900
_KEY = ["pattern_id", "from_pos", "to_pos"]


def boards(spans: DataFrame, stop_times: DataFrame, delays: DataFrame, gone: DataFrame) -> DataFrame:
    """(pattern_id, from_pos, to_pos, trip_id, leaves, alights, gone): expected times of every run on spans (pattern_id, from_pos, to_pos).

    `delays` is (trip_id, pos, delay), `gone` (trip_id, pos). A run without a delay is on time; one gone at either end isn't taken as next."""
    s = stop_times.select("trip_id", "pattern_id", "pos", "dep", "arr").join(delays.select("trip_id", "pos", "delay"), ["trip_id", "pos"], "left")
    s = s.join(gone.select("trip_id", "pos").withColumn("gone", F.lit(True)), ["trip_id", "pos"], "left")
    late = F.coalesce("delay", F.lit(0))
    at = s.join(spans.select(*_KEY).distinct(), "pattern_id").where("pos = from_pos or pos = to_pos")
    first = F.col("pos") == F.col("from_pos")
    out = at.groupBy(*_KEY, "trip_id").agg(F.max(F.when(first, F.col("dep") + late)).alias("leaves"), F.max(F.when(~first, F.col("arr") + late)).alias("alights"), F.coalesce(F.max("gone"), F.lit(False)).alias("gone"))
    return out.where("leaves is not null and alights is not null")


def live_stats(riders: DataFrame, runs: DataFrame) -> DataFrame:
    """(trip_key, metres_left, next_trip, next_leaves, then_trip, then_leaves, alight_at, arrives) of riders (trip_key, pattern_id,
    from_pos, to_pos, state, at, metres_left, walk_after, planned_alight, planned_arrival) and `boards`.

    `state` is 'to_ride' (at: now), 'riding' (at: when they boarded) or 'done' (no ride is left). Times are seconds of the service day."""
    run = F.struct("leaves", "trip_id", "alights")
    free = F.when(~F.col("gone"), run)
    r = runs.select(*_KEY, F.col("leaves").alias("__at"), run.alias("any"), free.alias("free"), F.lit(None).cast("long").alias("trip_key"))
    # what follows is sought backwards in time: a frame that only grows, where one up to the end would be read anew a row
    ahead = Window.partitionBy(*_KEY).orderBy(F.desc("__at"), F.desc("any.trip_id")).rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("free", F.when(F.col("free").isNotNull(), F.struct(F.col("free"), F.last("free", ignorenulls=True).over(ahead).alias("then"))))
    q = riders.where("state <> 'done'").select(*_KEY, F.col("at").cast("double").alias("__at"), F.lit(None).cast(r.schema["any"].dataType).alias("any"), F.lit(None).cast(r.schema["free"].dataType).alias("free"), F.col("trip_key").cast("long"))
    both = r.withColumn("__at", F.col("__at").cast("double")).unionByName(q)
    # a rider stands before the runs of the same second: what leaves now can be caught
    keys = [F.col("__at"), F.col("trip_key").isNull(), F.col("any.trip_id"), F.col("trip_key")]
    back, on = (Window.partitionBy(*_KEY).orderBy(*k).rowsBetween(Window.unboundedPreceding, 0) for k in (keys, [c.desc() for c in keys]))
    met = both.select("trip_key", F.last("any", ignorenulls=True).over(back).alias("before"), F.last("any", ignorenulls=True).over(on).alias("behind"), F.last("free", ignorenulls=True).over(on).alias("free")).where("trip_key is not null")
    x = riders.join(met, "trip_key", "left")
    gap = lambda c: F.abs(F.col(f"{c}.leaves") - F.col("at"))
    near = F.when(gap("before") <= F.coalesce(gap("behind"), F.lit(1e18)), F.col("before")).otherwise(F.coalesce("behind", "before"))
    x = x.withColumn("near", near).withColumn("on", F.when(F.abs(F.col("near.leaves") - F.col("at")) <= BOARDED_WITHIN, F.col("near")))
    riding, to_ride = F.col("state") == "riding", F.col("state") == "to_ride"
    alight = F.when(riding, F.coalesce(F.col("on.alights").cast("double"), "planned_alight"))
    following = F.when(to_ride, F.col("free"))
    x = x.withColumn("alight_at", alight).withColumn("f", following)
    arrives = F.coalesce(F.col("alight_at") + F.col("walk_after"), F.col("f.free.alights") + F.col("walk_after"), "planned_arrival")
    return x.select(
        "trip_key", "metres_left", F.col("f.free.trip_id").alias("next_trip"), F.col("f.free.leaves").alias("next_leaves"), F.col("f.then.trip_id").alias("then_trip"), F.col("f.then.leaves").alias("then_leaves"), "alight_at", arrives.alias("arrives")
    )
