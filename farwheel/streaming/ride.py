"""Progress on a trip's legs from fixes, timer ticks and commands, as windows over a trip's events.

Progress on a leg never falls. A tick after NO_FIX seconds without a fix gives the place by timetable, on rides only, moved by
the delay, and forward only. Cues come once each: when the stops left first reach the warning, and at the last stop. A
command ends the leg. All of it is window functions over (trip_key, t), so a table of events needs no Python, and a stream of
them the same windows over a micro-batch joined to the last row of each trip.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NO_FIX, WARN_STOPS = 20.0, 1


def progress(events: DataFrame, legs: DataFrame, warn: int = WARN_STOPS) -> DataFrame:
    """(trip_key, event_id, leg, along, to_end, stops_left, estimated, cue) of events (trip_key, event_id, t, what, along) and legs
    (trip_key, leg, ride, metres, departure, arrival, delay, stops array<double>).

    `what` is 'fix' (with `along`, metres on the leg), 'tick' or 'next'. Events past the last leg are of no leg and go."""
    order = Window.partitionBy("trip_key").orderBy("t", "event_id")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    e = events.withColumn("leg", F.sum(F.when(F.col("what") == "next", 1).otherwise(0)).over(so_far))
    e = e.withColumn("last_fix", F.last(F.when(F.col("what") == "fix", F.col("t")), ignorenulls=True).over(so_far))
    e = e.join(legs, ["trip_key", "leg"])
    stale = (F.col("what") == "tick") & (F.col("t") - F.col("last_fix") >= NO_FIX)
    share = (F.col("t") - (F.col("departure") + F.col("delay"))) / (F.col("arrival") - F.col("departure"))
    planned = F.when(F.col("ride") & (F.col("arrival") > F.col("departure")), F.col("metres") * F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    seen = F.when(F.col("what") == "fix", F.least("along", "metres")).when(stale, planned)
    in_leg = Window.partitionBy("trip_key", "leg").orderBy("t", "event_id")
    e = e.withColumn("stale", stale).withColumn("at", F.greatest(F.lit(0.0), F.coalesce(F.max(seen).over(in_leg.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0))))
    e = e.withColumn("stops_left", F.size(F.filter("stops", lambda s: s > F.col("at"))))
    before = F.coalesce(F.lag("stops_left").over(in_leg), F.size("stops"))
    cue = F.when((F.col("stops_left") == 0) & (before > 0), "alight_now").when(F.col("stops_left").between(1, warn) & (before > warn), "one_stop_left")
    e = e.withColumn("cue", F.when(F.col("ride"), cue))
    return e.select("trip_key", "event_id", "leg", F.col("at").alias("along"), (F.col("metres") - F.col("at")).alias("to_end"), "stops_left", F.col("stale").alias("estimated"), "cue")
