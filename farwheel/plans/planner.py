"""Multicriteria journey search over many requests at once, as relational rounds.

A label is (request, stop, arr, walk, by_ride, legs). A round boards every pattern at the labels' stops, takes the earliest run,
alights at every later position, and walks on; labels that another beats weakly on (arr, walk) at their stop go, each round
for itself. The earliest run is looked up by slots of time: a label meets the runs of its slot and the first runs of later slots, so
no label meets all trips. Rounds are checkpointed, since each reads the last one several times. The timetable is neither
shuffled nor written where a round's questions are counted to be FEW: they are sent to its scan.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.functions import geo, times
from farwheel.operators import grouped, spatial, timetable
from farwheel.operators.graph import _checkpoints, _scratch, cut

LEG = "array<struct<kind:string,from_stop:bigint,to_stop:bigint,trip_id:bigint,dep:int,arr:int,walk:double>>"
TRANSFER = 60
#: Arrive-by: seconds kept at the stop before the first ride, and how far before the window the first pass starts.
BOARD_BUFFER, LOOKBACK = 120, 3600
#: Seconds by which a walk may overshoot a ride that is still caught.
GRACE = 30
#: Rows of questions up to which they are broadcast to the timetable; above, both sides are shuffled.
FEW = 50_000
#: Seconds of a slot of departures: a run meets the questions of its slot, a question the first runs of later slots.
SLOT = 300


def _leg(kind: str, a: str, b: str, trip: str | None, dep: str, arr: str, walk) -> F.Column:
    trip_id = F.col(trip) if trip else F.lit(None).cast("bigint")
    return F.array(F.struct(F.lit(kind).alias("kind"), F.col(a).cast("bigint").alias("from_stop"), F.col(b).cast("bigint").alias("to_stop"), trip_id.alias("trip_id"), F.col(dep).cast("int").alias("dep"), F.col(arr).cast("int").alias("arr"), walk.alias("walk")))


def _sent(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= FEW else rows


def seeds(requests: DataFrame, stops: DataFrame, radius: float) -> DataFrame:
    """Labels at all stops near each request's start."""
    near = spatial.within(requests.select("request", "lat", "lon", "depart"), spatial.second(stops, "stop_id", "lat", "lon"), radius)
    arr = (F.col("depart") + times.walk_seconds(F.col("metres"))).cast("int")
    rows = near.select("request", F.col("stop_id2").alias("stop_id"), arr.alias("arr"), F.col("metres").alias("walk"), F.lit(False).alias("by_ride"), "depart")
    return rows.withColumn("legs", _leg("walk", "stop_id", "stop_id", None, "depart", "arr", F.col("walk"))).drop("depart")


def _first_runs(asks: DataFrame, runs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """((pattern_id, pos, t, dep), (pattern_id, pos, dep, run)): the first departure at or after t of `n` asks (pattern_id, pos, t), and the
    least run (trip_id, offset) of each such departure."""
    # the first run at or after t: among those of its slot, or else the first of a later slot; then its trip. Least numbers, not least
    # structs, over all runs: those would be sorted
    key = ["pattern_id", "pos"]
    if n > FEW:
        # asks of every second would meet all runs of their slot: the departure behind each ask is told by a window instead
        left = runs.join(asks.select(*key).distinct(), key, "left_semi").select(*key, F.col("dep").alias("t"), F.col("dep")).distinct()
        both = left.unionByName(asks.select(*key, "t", F.lit(None).cast("int").alias("dep")).distinct())
        w = Window.partitionBy(*key).orderBy(F.desc("t"), F.desc_nulls_last("dep")).rowsBetween(Window.unboundedPreceding, 0)
        found = both.select(*key, "t", F.col("dep").isNull().alias("asked"), F.last("dep", True).over(w).alias("dep"))
        found = cut(found.where("asked and dep is not null").drop("asked"))
    else:
        slot = lambda t: F.floor(t / SLOT).alias("slot")
        least = F.min("dep").alias("dep")
        slotted = runs.select("pattern_id", "pos", "dep", slot(F.col("dep")))
        firsts = slotted.join(_sent(asks.select("pattern_id", "pos").distinct(), n), key, "left_semi").groupBy(*key, F.col("slot").alias("later")).agg(least)
        wanted = _sent(asks.select("pattern_id", "pos", "t", slot(F.col("t"))).distinct(), n)
        own = wanted.join(slotted, ["pattern_id", "pos", "slot"]).where("dep >= t").groupBy("pattern_id", "pos", "t").agg(least)
        after = wanted.join(firsts, key).where("later > slot").groupBy("pattern_id", "pos", "t").agg(least)
        found = cut(own.unionByName(after).groupBy("pattern_id", "pos", "t").agg(least))
    taken = _sent(found.select("pattern_id", "pos", "dep").distinct(), n).join(runs, ["pattern_id", "pos", "dep"]).groupBy("pattern_id", "pos", "dep").agg(F.min(F.struct("trip_id", "offset")).alias("run"))
    return found, taken


def ride(labels: DataFrame, pattern_stops: DataFrame, runs: DataFrame, stop_times: DataFrame, suspended: DataFrame | None = None) -> DataFrame:
    """Labels after one ride from each label."""
    ready = F.col("arr") + F.when(F.col("by_ride"), TRANSFER).otherwise(0)
    at = labels.join(pattern_stops.where("not is_last").select("stop_id", "pattern_id", "pos"), "stop_id").withColumn("t", ready.cast("int"))
    at = timetable.skyline(at, ["request", "pattern_id", "pos"], "stop_id")
    asks = cut(at.select("request", "pattern_id", "pos", "t", F.col("stop_id").alias("from_stop"), "walk", "legs"))
    n = asks.count()
    found, taken = _first_runs(asks, runs, n)
    on = asks.join(found, ["pattern_id", "pos", "t"]).join(taken, ["pattern_id", "pos", "dep"]).select("request", "pattern_id", "pos", "from_stop", "walk", "legs", "t", "run.trip_id", "run.offset", "dep")
    later = stop_times.select("trip_id", F.col("pos").alias("pos2"), F.col("stop_id").alias("to_stop"), F.col("arr").alias("sched"))
    off = _sent(on, n).join(later, "trip_id").where("pos2 > pos").withColumn("arr2", (F.col("sched") + F.col("offset")).cast("int"))
    if suspended is not None:
        off = off.join(suspended.select(F.col("stop_id").alias("to_stop")), "to_stop", "left_anti")
    leg = _leg("ride", "from_stop", "to_stop", "trip_id", "dep", "arr2", F.lit(0.0))
    return off.select("request", F.col("to_stop").alias("stop_id"), F.col("arr2").alias("arr"), "walk", F.lit(True).alias("by_ride"), F.concat("legs", leg).alias("legs"))


def walk_on(labels: DataFrame, footpaths: DataFrame, cap: float) -> DataFrame:
    """Labels after one footpath from labels that came by ride."""
    rows = labels.where("by_ride").join(footpaths, labels["stop_id"] == footpaths["from_stop"])
    rows = rows.withColumn("dep2", F.col("arr")).withColumn("arr2", (F.col("arr") + times.walk_seconds(F.col("metres"))).cast("int")).withColumn("walk2", F.col("walk") + F.col("metres")).where(F.col("walk2") <= cap)
    leg = _leg("walk", "from_stop", "to_stop", None, "dep2", "arr2", F.col("metres"))
    return rows.select("request", F.col("to_stop").alias("stop_id"), F.col("arr2").alias("arr"), F.col("walk2").alias("walk"), F.lit(False).alias("by_ride"), F.concat("legs", leg).alias("legs"))


class Network(NamedTuple):
    """What all searches of a day share."""

    stops: DataFrame
    pattern_stops: DataFrame
    stop_times: DataFrame
    runs: DataFrame
    footpaths: DataFrame
    suspended: DataFrame | None
    radius: float


def network(stops: DataFrame, pattern_stops: DataFrame, stop_times: DataFrame, service_days: DataFrame, day: str, radius: float = 400.0, suspended: DataFrame | None = None, since: int | None = None, keep: bool = True) -> Network:
    """The runs of a day and its neighbours in seconds of that day, from `since` on, and footpaths. `keep`: footpaths as
    a checkpoint, for searches of several rounds or passes; runs are thrice the timetable and read from it each time."""
    spark = stops.sparkSession
    if not _checkpoints(spark):
        spark.sparkContext.setCheckpointDir(_scratch(spark))
    if suspended is not None:
        stops = stops.join(suspended, "stop_id", "left_anti")
    paths = spatial.footpaths(stops, radius)
    today = F.lit(day).cast("date")
    shift = F.datediff("day", today)
    near = service_days.where(shift.between(-1, 1)).groupBy("service_id").agg(F.collect_set(shift * timetable.DAY).alias("offsets"))
    # a row a service: a stop time looks its days up once
    runs = stop_times.select("trip_id", "pattern_id", "service_id", "pos", "dep").join(F.broadcast(near), "service_id").withColumn("offset", F.explode("offsets"))
    runs = runs.select("trip_id", "pattern_id", "pos", (F.col("dep") + F.col("offset")).cast("int").alias("dep"), "offset")
    if since is not None:
        runs = runs.where(F.col("dep") >= since)
    if keep:
        paths = cut(paths)
    return Network(stops, pattern_stops, stop_times, runs, paths, suspended, radius)


def _ends(requests: DataFrame, net: Network) -> DataFrame:
    near = spatial.within(requests.select("request", F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")), spatial.second(net.stops, "stop_id", "lat", "lon"), net.radius)
    return near.select("request", F.col("stop_id2").alias("stop_id"), F.col("metres").alias("egress"))


def search(requests: DataFrame, net: Network, max_transfers: int = 2, cap: float = 1000.0) -> DataFrame:
    """(request, arr, walk, rides, legs): every journey that no other of as many rides beats on (arr, walk)."""
    runs = net.runs
    first = requests.agg(F.min("depart")).first()[0]
    if first is not None:
        runs = runs.where(F.col("dep") >= first)
    return _rounds(timetable.skyline(seeds(requests, net.stops, net.radius), ["request", "stop_id"]), _ends(requests, net), net._replace(runs=runs), max_transfers, cap)


def _rounds(labels: DataFrame, ends: DataFrame, net: Network, max_transfers: int, cap: float) -> DataFrame:
    """The journeys of `search` from labels (request, stop_id, arr, walk, by_ride, legs) to ends (request, stop_id, egress)."""
    out = None
    for k in range(max_transfers + 1):
        rode = ride(labels, net.pattern_stops, net.runs, net.stop_times, net.suspended).where(F.col("walk") <= cap)
        if k == max_transfers:  # nothing goes on from elsewhere
            rode = rode.join(ends.select("request", "stop_id"), ["request", "stop_id"], "left_semi")
        rode = timetable.skyline(rode, ["request", "stop_id"], "legs").checkpoint()
        done = rode.join(ends, ["request", "stop_id"]).withColumn("t0", F.col("arr")).withColumn("arr", (F.col("arr") + times.walk_seconds(F.col("egress"))).cast("int")).withColumn("walk", F.round(F.col("walk") + F.col("egress"), 3)).where(F.col("walk") <= cap)
        done = done.withColumn("legs", F.concat("legs", _leg("walk", "stop_id", "stop_id", None, "t0", "arr", F.col("egress"))))
        found = timetable.skyline(done, ["request"], "legs").select("request", "arr", "walk", F.lit(k + 1).alias("rides"), "legs")
        out = found if out is None else out.unionByName(found)
        if k < max_transfers:
            labels = timetable.skyline(rode.unionByName(walk_on(rode, net.footpaths, cap)), ["request", "stop_id"], "legs").checkpoint()
    return out


def plan(requests: DataFrame, stops: DataFrame, pattern_stops: DataFrame, stop_times: DataFrame, service_days: DataFrame, day: str, max_transfers: int = 2, cap: float = 1000.0, radius: float = 400.0, max_extra: int = 3600, suspended: DataFrame | None = None) -> DataFrame:
    """(request, arr, walk, rides, legs): the journeys of (request, lat, lon, to_lat, to_lon, depart), skyline a number of rides,
    arriving at most `max_extra` seconds after the first. Waits have no limit."""
    since = requests.agg(F.min("depart")).first()[0]
    out = search(requests, network(stops, pattern_stops, stop_times, service_days, day, radius, suspended, since, keep=max_transfers > 0), max_transfers, cap)
    fastest = F.min("arr").over(Window.partitionBy("request"))
    return out.withColumn("__f", fastest).where(F.col("arr") <= F.col("__f") + max_extra).drop("__f")


def leave_late(journeys: DataFrame) -> DataFrame:
    """`journeys` with `departure` and `last_leave`: the walking before the first ride moves as late as that ride allows."""
    legs = F.col("legs")
    rows = journeys.withColumn("__r", F.array_position(F.transform(legs, lambda x: x["kind"]), "ride"))  # from 1
    rows = rows.withColumn("__ride", F.get(legs, F.col("__r") - 1)).withColumn("__before", F.get(legs, F.col("__r") - 2))
    slack = F.when(F.col("__r") > 1, F.greatest(F.lit(0), F.col("__ride.dep") - BOARD_BUFFER - F.col("__before.arr"))).otherwise(0)
    first = F.get(legs, F.lit(0))["dep"]
    rows = rows.withColumn("__slack", slack).withColumn("last_leave", F.when(F.col("__r") > 1, F.col("__ride.dep") - (F.col("__before.arr") - first)).otherwise(first))

    def later(leg: F.Column, i: F.Column) -> F.Column:
        by = F.when(i < F.col("__r") - 1, F.col("__slack")).otherwise(0)
        return leg.withField("dep", leg["dep"] + by).withField("arr", leg["arr"] + by)

    rows = rows.withColumn("legs", F.transform(legs, later))
    return rows.withColumn("departure", F.get("legs", F.lit(0))["dep"]).drop("__r", "__ride", "__before", "__slack")


def _boards(ends: DataFrame, net: Network, rides: int) -> DataFrame:
    """(request, pattern_id, pos, stop_id): where a line can be boarded that leads to an end, by at most so many rides; no time is looked at."""
    at = net.pattern_stops.where("not is_last").select("pattern_id", "pos", "stop_id")
    to = net.pattern_stops.select("pattern_id", F.col("pos").alias("pos2"), F.col("stop_id").alias("to_stop"))
    goals = ends.select("request", F.col("stop_id").alias("to_stop")).distinct()
    found = None
    for k in range(rides):
        found = cut(goals.join(to, "to_stop").join(at, "pattern_id").where("pos2 > pos").select("request", "pattern_id", "pos", "stop_id").distinct())
        if k + 1 < rides:
            on = found.select("request", F.col("stop_id").alias("to_stop"))
            goals = goals.unionByName(on).unionByName(on.join(net.footpaths, "to_stop").select("request", F.col("from_stop").alias("to_stop"))).distinct()
    return found


def _followed(request: list, depart: list, start: list, onward: list) -> list[tuple]:
    """The moments of one request, in order, that follow from one another from `start` on."""
    out, at = [], start[0]
    for t, then in zip(depart, onward, strict=True):
        if t == at:
            out.append((request[0], t))
            at = then
    return out


def _front(found: DataFrame, most: int) -> DataFrame:
    """Journeys of at most `most` rides that no other of their request beats on later departure, less walking and fewer rides."""
    order = Window.partitionBy("request").orderBy(F.desc("departure"))
    upto, before = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -1)
    beaten = F.lit(False)
    for r in range(1, most + 1):
        no_more = lambda k: F.min(F.when(F.col("rides") <= k, F.col("walk")))
        by = (no_more(r).over(before) <= F.col("walk")) | (no_more(r).over(upto) < F.col("walk")) | (no_more(r - 1).over(upto) <= F.col("walk"))
        beaten = F.when(F.col("rides") == r, F.coalesce(by, F.lit(False))).otherwise(beaten)
    return found.withColumn("__beaten", beaten).where("not __beaten").drop("__beaten")


def arrive_by(requests: DataFrame, net: Network, max_transfers: int = 2, cap: float = 1000.0, window: int = 1800, max_extra: int = 3600) -> DataFrame:
    """(request, departure, arr, walk, rides, legs) of (request, lat, lon, to_lat, to_lon, deadline): journeys that arrive by the
    deadline and that no other beats on later departure, less walking and fewer rides.

    A pass searches forward from a second after the last moment at which the earliest ride of the pass before could still be caught, until
    nothing fits; a busy line has a pass for each of its runs. So all passes run at once: each moment at which one could begin is a
    search of its own, and those that follow from one another are taken."""
    asks = requests.withColumn("depart", (F.col("deadline") - window - LOOKBACK).cast("int"))
    first, until = asks.agg(F.min("depart"), F.max("deadline")).first()
    if first is None:
        first, until = 0, 0
    # what leaves or arrives after the last deadline is of no use
    on = lambda t, offset: (F.col(t) + offset).between(first, until)
    runs = net.runs.where(on("dep", 0))
    arriving = on("arr", 0) | on("arr", timetable.DAY) | on("arr", -timetable.DAY)
    net = net._replace(runs=runs, stop_times=net.stop_times.where(arriving))
    ends = cut(_ends(requests, net))
    boards = _boards(ends, net, max_transfers + 1)
    start = timetable.skyline(seeds(asks, net.stops, net.radius), ["request", "stop_id"]).join(asks.select("request", "depart", "deadline"), "request")
    start = start.join(boards.select("request", "stop_id").distinct(), ["request", "stop_id"], "left_semi")
    start = cut(start.select("request", "stop_id", "walk", (F.col("arr") - F.col("depart")).alias("access"), F.col("depart").alias("start"), "deadline"))
    lines = cut(start.join(boards, ["request", "stop_id"]).select("request", "pattern_id", "pos", "access", "start", "deadline").distinct())
    key = ["pattern_id", "pos"]
    left = runs.join(F.broadcast(lines.select(*key).distinct()), key, "left_semi").select(*key, "dep").distinct()
    moments = F.broadcast(lines).join(left, key).withColumn("depart", (F.col("dep") - F.col("access") + 1).cast("int")).where("depart > start and depart < deadline")
    moments = cut(moments.select("request", "depart").unionByName(asks.select("request", "depart")).distinct())
    each = F.struct("request", "depart").alias("request")
    labels = moments.join(F.broadcast(start), "request").withColumn("arr", (F.col("depart") + F.col("access")).cast("int")).withColumn("by_ride", F.lit(False))
    labels = labels.withColumn("legs", _leg("walk", "stop_id", "stop_id", None, "depart", "arr", F.col("walk")))
    labels = labels.select(each, "stop_id", "arr", "walk", "by_ride", "legs")
    fits = _rounds(labels, moments.join(F.broadcast(ends), "request").select(each, "stop_id", "egress"), net, max_transfers, cap)
    fits = fits.select("request.request", "request.depart", "arr", "walk", "rides", "legs").join(F.broadcast(asks.select("request", F.col("depart").alias("start"), "deadline")), "request").where("arr <= deadline")
    fits = cut(leave_late(fits))
    onward = fits.groupBy("request", "depart").agg(F.first("start").alias("start"), (F.min("last_leave") + 1).alias("onward"))
    kind = dict(requests.dtypes)["request"]
    taken = grouped.by_key(onward, "request", ["depart"], _followed, f"request {kind}, depart int")
    found = fits.join(taken, ["request", "depart"]).select("request", "departure", "arr", "walk", "rides", "legs").distinct()
    latest = F.max("departure").over(Window.partitionBy("request"))
    return _front(found, max_transfers + 1).withColumn("__l", latest).where(F.col("departure") >= F.col("__l") - max_extra).drop("__l")


def _earliest_arrivals(asks: DataFrame, net: Network, n: int) -> DataFrame:
    """(from_stop, to_stop, t, run struct<arr2, dep2, trip2>): of `n` asks (from_stop, to_stop, t) the earliest arrival on any line that
    leaves at t or later.

    The first run of each line arrives at some moment; whatever arrives earlier also leaves by then, so both ends of a ride are sought
    between t and that moment only, by slots, and the timetable isn't shuffled."""
    key = ["from_stop", "to_stop", "t"]
    at_stop = lambda pos, stop: net.pattern_stops.select("pattern_id", F.col("pos").alias(pos), F.col("stop_id").alias(stop))
    lines = asks.join(at_stop("pos", "from_stop"), "from_stop").join(at_stop("pos2", "to_stop"), ["pattern_id", "to_stop"]).where("pos2 > pos")
    at = cut(lines.select(*key, "pattern_id", "pos").distinct())
    many = at.count()
    found, taken = _first_runs(at, net.runs, many)
    first = at.join(found, ["pattern_id", "pos", "t"]).join(taken, ["pattern_id", "pos", "dep"]).select(*key, "pos", "run.trip_id", "run.offset")
    off = net.stop_times.select("trip_id", "pattern_id", F.col("pos").alias("pos2"), F.col("stop_id").alias("to_stop"), F.col("arr").alias("sched"))
    arr = (F.col("sched") + F.col("offset")).cast("int")
    by = _sent(first, many).join(off.drop("pattern_id"), ["trip_id", "to_stop"]).where("pos2 > pos").groupBy(*key).agg(F.min(arr).alias("by"))
    wanted = cut(at.join(by, key))
    slots = cut(wanted.withColumn("slot", F.explode(F.sequence(F.floor(F.col("t") / SLOT), F.floor(F.col("by") / SLOT)))))
    most = slots.count()
    left = net.runs.withColumnRenamed("dep", "dep2").withColumn("slot", F.floor(F.col("dep2") / SLOT))
    left = _sent(slots, most).join(left, ["pattern_id", "pos", "slot"]).where("dep2 between t and by")
    # what arrives is told by the second of the day, as a trip may run on several days
    day = lambda slot: F.pmod(slot, F.lit(timetable.DAY // SLOT)).alias("slot")
    ends = _sent(slots.select("pattern_id", "to_stop", "t", "by", day(F.col("slot"))).distinct(), most)
    off = ends.join(off.withColumn("slot", day(F.floor(F.col("sched") / SLOT))), ["pattern_id", "to_stop", "slot"])
    off = off.where(F.pmod(F.col("sched") - F.col("t"), F.lit(timetable.DAY)) <= F.col("by") - F.col("t")).select("trip_id", "to_stop", "t", "pos2", "sched").distinct()
    rides = left.select(*key, "pos", "trip_id", "offset", "dep2").join(off, ["trip_id", "to_stop", "t"]).where("pos2 > pos").withColumn("arr2", arr)
    return rides.groupBy(*key).agg(F.min(F.struct("arr2", "dep2", F.col("trip_id").alias("trip2"))).alias("run"))


def reprice(journeys: DataFrame, net: Network, routed: DataFrame, cap: float, max_extra: int = 3600, deadline: DataFrame | None = None) -> DataFrame:
    """`journeys` with real walks: (from_stop, to_stop, metres) of `routed` where it has them, else the estimate with its detour.

    A ride that the walk misses by more than GRACE seconds is boarded anew: on the earliest arrival between its stops on
    any line; without one the journey goes, as it does beyond `cap` metres of walking, after `deadline` (request, deadline), or
    `max_extra` seconds after the request's first arrival (with a deadline: before its last departure)."""
    rows = cut(journeys.withColumn("j", F.xxhash64("request", F.to_json("legs"))).withColumn("size", F.size("legs")))
    longest = rows.agg(F.max("size")).first()[0] or 0
    state = rows.select("j", "request", "rides", "legs", "size", F.get("legs", F.lit(0))["dep"].alias("t"), F.array().cast(LEG).alias("out"))
    for i in range(longest):
        x = state.withColumn("x", F.get("legs", F.lit(i)))
        over = x.where("x is null")
        walks = x.where("x.kind = 'walk'").withColumn("from_stop", F.col("x.from_stop")).withColumn("to_stop", F.col("x.to_stop"))
        walks = walks.join(routed.select("from_stop", "to_stop", F.col("metres").alias("real")), ["from_stop", "to_stop"], "left")
        straight = F.col("x.from_stop") == F.col("x.to_stop")  # from or to a place: no stop pair has its route
        metres = F.when(straight | F.col("real").isNull(), F.col("x.walk") * times.DETOUR).otherwise(F.col("real"))
        walks = walks.withColumn("m", metres).withColumn("end", (F.col("t") + F.round(F.col("m") / times.SPEED)).cast("int"))
        leg = F.col("x").withField("walk", F.col("m")).withField("dep", F.col("t")).withField("arr", F.col("end"))
        walks = walks.select("j", "request", "rides", "legs", "size", F.col("end").alias("t"), F.array_append("out", leg).alias("out"))
        rides = x.where("x.kind = 'ride'")
        kept = rides.where(F.col("x.dep") + GRACE >= F.col("t")).select("j", "request", "rides", "legs", "size", F.col("x.arr").alias("t"), F.array_append("out", F.col("x")).alias("out"))
        late = cut(rides.where(F.col("x.dep") + GRACE < F.col("t")).withColumn("from_stop", F.col("x.from_stop")).withColumn("to_stop", F.col("x.to_stop")))
        on_time = over.drop("x").unionByName(walks).unionByName(kept)
        n = late.count()
        if not n:
            state = on_time.repartition("j").checkpoint()  # a union has its parts' partitions, thrice as many a leg
            continue
        key = ["from_stop", "to_stop", "t"]
        runs = _earliest_arrivals(late.select(*key).distinct(), net, n)
        again = late.join(runs, key).select("j", "run", F.struct("request", "rides", "legs", "size", "out", "x").alias("s"))
        leg = F.col("s.x").withField("trip_id", F.col("run.trip2")).withField("dep", F.col("run.dep2")).withField("arr", F.col("run.arr2"))
        again = again.select("j", "s.request", "s.rides", "s.legs", "s.size", F.col("run.arr2").alias("t"), F.array_append("s.out", leg).alias("out"))
        state = on_time.unionByName(again).repartition("j").checkpoint()
    out = state.select("request", F.col("t").alias("arr"), F.aggregate("out", F.lit(0.0), lambda a, x: a + F.coalesce(x["walk"], F.lit(0.0))).alias("walk"), "rides", F.get("out", F.lit(0))["dep"].alias("departure"), F.col("out").alias("legs")).where(F.col("walk") <= cap)
    if deadline is not None:
        out = out.join(deadline, "request").where("arr <= deadline").drop("deadline")
        edge = F.max("departure").over(Window.partitionBy("request"))
        return out.withColumn("__e", edge).where(F.col("departure") >= F.col("__e") - max_extra).drop("__e")
    edge = F.min("arr").over(Window.partitionBy("request"))
    return out.withColumn("__e", edge).where(F.col("arr") <= F.col("__e") + max_extra).drop("__e")


def direct_walk(requests: DataFrame) -> DataFrame:
    """(request, metres, seconds) on foot all the way, straight line."""
    m = geo.haversine(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon"))
    return requests.select("request", m.alias("metres"), times.walk_seconds(m).alias("seconds"))
