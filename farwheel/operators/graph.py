"""Graphs as edge tables: components, chains and segment merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 64) -> DataFrame:
    """(node, component): the least node reachable, of `nodes` (node) and `edges` (a, b).

    Labels spread along edges and then jump through the label's own label, so rounds grow with the logarithm of a
    component's length; checkpoints cut the lineage."""
    spark = nodes.sparkSession
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    state = nodes.select("node", F.col("node").alias("component"))
    if not _checkpoints(spark):
        spark.sparkContext.setCheckpointDir(_scratch(spark))
    both, state = both.checkpoint(), state.checkpoint()
    for _ in range(rounds):
        near = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("component").alias("m"))
        step = state.join(near, state["node"] == near["a"], "left").select("node", F.least("component", F.coalesce("m", "component")).alias("component"))
        up = step.select(F.col("node").alias("n2"), F.col("component").alias("c2"))
        new = step.join(up, step["component"] == up["n2"]).select("node", F.col("c2").alias("component")).checkpoint()
        if new.join(state.withColumnRenamed("component", "was"), "node").where("component <> was").isEmpty():
            return new
        state = new
    raise RuntimeError(f"components: not settled after {rounds} rounds")


def _checkpoints(spark) -> bool:
    return spark.sparkContext._jsc.sc().getCheckpointDir().isDefined()


def _scratch(spark) -> str:
    """The session's shared folder; a temporary one only where it names none and all of Spark runs in one process."""
    import re
    import tempfile

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return "file://" + tempfile.mkdtemp(prefix="farwheel-ckpt-")


def _ranked(links: DataFrame, rounds: int) -> DataFrame:
    """(arc, head, rank, low, open) of (arc, before): the first arc of each list and the steps from it. By pointer jumping: a round doubles
    how far back each arc has looked, so rounds grow with the logarithm of the longest list. Arcs of a ring stay open, and `low` is
    then the ring's least arc."""
    first = F.col("before").isNull()
    state = cut(links.select("arc", F.coalesce("before", "arc").alias("head"), F.when(first, 0).otherwise(1).cast("long").alias("rank"), F.least("arc", F.coalesce("before", "arc")).alias("low"), (~first).alias("open")))
    was = None
    for _ in range(rounds):
        now = tuple(state.where("open").agg(F.count("*"), F.sum(F.xxhash64("arc", "low").cast("decimal(38,0)"))).first())
        if not now[0] or now == was:
            return state
        was = now
        far = state.select(F.col("arc").alias("head"), F.col("head").alias("__head"), F.col("rank").alias("__rank"), F.col("low").alias("__low"), F.col("open").alias("__open"))
        step = state.where("open").join(far, "head").select("arc", F.col("__head").alias("head"), (F.col("rank") + F.col("__rank")).alias("rank"), F.least("low", "__low").alias("low"), F.col("__open").alias("open"))
        state = cut(step.unionByName(state.where("not open")))
    raise RuntimeError(f"chains: not settled after {rounds} rounds")


def chains(segments: DataFrame, rounds: int = 64) -> DataFrame:
    """(chain, pos, id, forward): maximal chains of segments (id, key, a, b, oneway) of one key, each segment once, in order from 0.

    A chain goes on through a node that two segments of its key meet at; one-way segments run from a to b and go on where one comes in
    and one goes out, the others are walked either way. Rings begin at their least segment. A chain is named by its first segment."""
    arcs = segments.select("key", "oneway", (F.col("id") * 2).alias("arc"), F.col("a").alias("from"), F.col("b").alias("to"))
    back = segments.where("not oneway").select("key", "oneway", (F.col("id") * 2 + 1).alias("arc"), F.col("b").alias("from"), F.col("a").alias("to"))
    arcs = cut(arcs.unionByName(back))
    ends = arcs.select("key", "oneway", "arc", F.explode(F.array(F.struct(F.col("from").alias("node"), F.lit(1).alias("out")), F.struct(F.col("to").alias("node"), F.lit(0).alias("out")))).alias("e")).select("key", "oneway", "arc", "e.*")
    counts = ends.groupBy("key", "oneway", "node").agg(F.sum("out").alias("outs"), F.sum(1 - F.col("out")).alias("ins"))
    through = counts.where(F.col("outs") == F.when(F.col("oneway"), 1).otherwise(2)).where("ins = outs").select("key", "oneway", "node")
    into = arcs.select("key", "oneway", F.col("to").alias("node"), F.col("arc").alias("before")).join(through, ["key", "oneway", "node"])
    nxt = arcs.select("key", "oneway", F.col("from").alias("node"), "arc").join(into, ["key", "oneway", "node"]).where(F.floor(F.col("arc") / 2) != F.floor(F.col("before") / 2))
    links = cut(arcs.select("arc").join(nxt.select("arc", "before"), "arc", "left"))
    lists = _ranked(links, rounds)
    rings = lists.where("open").select("arc", "low")
    if not rings.isEmpty():
        cuts = links.join(rings, "arc").select("arc", F.when(F.col("arc") != F.col("low"), F.col("before")).alias("before"))
        lists = lists.where("not open").unionByName(_ranked(cuts, rounds))
    # walked either way, a chain stands twice: the way of the lesser first segment counts
    told = lists.select("arc", "head", "rank", F.floor(F.col("arc") / 2).alias("id"))
    best = told.groupBy("id").agg(F.min(F.struct("head", "arc", "rank")).alias("v"))
    return best.select(F.floor(F.col("v.head") / 2).alias("chain"), F.col("v.rank").alias("pos"), "id", (F.col("v.arc") % 2 == 0).alias("forward"))


def cut(df: DataFrame) -> DataFrame:
    """`df` with its lineage cut, in the shared folder; it is computed once and written from the cache."""
    if not _checkpoints(df.sparkSession):
        df.sparkSession.sparkContext.setCheckpointDir(_scratch(df.sparkSession))
    df.persist()
    out = df.checkpoint()
    df.unpersist()
    return out


def merge_segments(segments: DataFrame) -> DataFrame:
    """(mode, a, b, routes, directions) of (mode, from_node, to_node, route): both ways of a hop are one segment."""
    a, b = F.least("from_node", "to_node"), F.greatest("from_node", "to_node")
    way = F.when(F.col("from_node") <= F.col("to_node"), 1).otherwise(-1)
    return segments.groupBy("mode", a.alias("a"), b.alias("b")).agg(F.array_sort(F.collect_set("route")).alias("routes"), F.size(F.collect_set(way)).alias("directions"))


def road_edges(ways: DataFrame) -> DataFrame:
    """(way_id, from_lat, from_lon, to_lat, to_lon) of (way_id, points array<struct<lat, lon>>, oneway), no self-loops."""
    hops = F.filter(F.transform(F.sequence(F.lit(1), F.size("points") - 1), lambda i: F.struct(F.element_at("points", i).alias("p"), F.element_at("points", i + 1).alias("q"))), lambda h: (h["p"] != h["q"]))
    one = ways.where(F.size("points") > 1).select("way_id", "oneway", F.explode(hops).alias("h"))
    ahead = one.select("way_id", F.col("h.p").alias("p"), F.col("h.q").alias("q"))
    back = one.where("not oneway").select("way_id", F.col("h.q").alias("p"), F.col("h.p").alias("q"))
    return ahead.unionByName(back).select("way_id", F.col("p.lat").alias("from_lat"), F.col("p.lon").alias("from_lon"), F.col("q.lat").alias("to_lat"), F.col("q.lon").alias("to_lon"))


def ordinals(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """`rows`, which are distinct in `order`, with `name`: their place from 0. Ranges are ranked for themselves and moved by the counts
    of those before them, so no task holds all rows; only a count a range is joined."""
    w = Window.partitionBy("__range").orderBy(*order)
    ranged = cut(rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    counts = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = counts.select("__range", before.alias("__before"))
    return ranged.join(start, "__range").withColumn(name, F.row_number().over(w) - 1 + F.col("__before")).drop("__range", "__before")


def canonical(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, lat_e5, lon_e5), (edge, a, b, flags, name)) of nodes (key, lat_e5, lon_e5) and edges (a, b: keys, flags, name).

    Nodes are numbered by place, edges by (a, b, flags, name) with a <= b, equal ones once: one graph has one form."""
    spark = nodes.sparkSession
    if not _checkpoints(spark):
        spark.sparkContext.setCheckpointDir(_scratch(spark))
    placed = ordinals(nodes.select("lat_e5", "lon_e5").distinct(), ["lat_e5", "lon_e5"], "node")
    of = nodes.join(placed, ["lat_e5", "lon_e5"]).select("key", "node")
    both = edges.join(of.select(F.col("key").alias("a"), F.col("node").alias("x")), "a").join(of.select(F.col("key").alias("b"), F.col("node").alias("y")), "b")
    one = both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "flags", "name").distinct()
    return placed.select("node", "lat_e5", "lon_e5"), ordinals(one, ["a", "b", "flags", "name"], "edge")
