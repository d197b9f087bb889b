"""The walking graph of classified ways: both sides of busy roads, corners and crossings at their junctions, chains contracted.

Ways are (way, nodes array<long>, kind, sub, sided, left, right, covered, name), places (node, x, y, cross) in plane metres; `cross` is the
crossing's type where one is tagged, else -1. Sided ways are busy roads, walked along either side, 6 m off the middle; where two or more
of their arms meet, each gap between neighbouring arms has a corner, and a crossing leads over each arm if another way meets them, three
arms do or one is tagged. All steps are joins and windows keyed by way, segment or junction; a junction's arms are few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.functions import walking
from farwheel.operators import graph, lines
from farwheel.operators.graph import cut

#: Fixed values in metres: how far a side lies off the middle, what simplifying may move; and the least edges of an island that stays.
OFFSET, SIMPLER, ISLAND = 6.0, 0.7, 20
_POINTS = "array<struct<x:double,y:double>>"


def _segments(ways: DataFrame, places: DataFrame) -> DataFrame:
    """(seg, way, kind, sub, sided, left, right, covered, name, nodes, points): ways cut at shared nodes, and busy ones at tagged crossings.
    Nodes without a place and repeats in a row are left out; a crossing runs from its first node to its last."""
    crossing = F.col("kind") == walking.CROSSING
    each = ways.select("way", "sided", crossing.alias("crossing"), F.posexplode("nodes").alias("i", "node")).join(places, "node")
    w = Window.partitionBy("way").orderBy("i")
    each = each.withColumn("__was", F.lag("node").over(w)).where("__was is null or __was <> node").drop("__was")
    each = each.withColumn("end", F.lag("node").over(w).isNull() | F.lead("node").over(w).isNull()).where("end or not crossing")
    uses = each.groupBy("node").agg(F.count("*").alias("uses"))
    each = each.join(uses, "node").withColumn("cut", F.col("end") | (F.col("uses") >= 2) | (F.col("sided") & (F.col("cross") >= 0)))
    part = F.sum(F.when(F.col("cut"), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("part", F.coalesce(part, F.lit(0)))
    # a node where a way is cut ends one part and begins the next
    both = each.withColumn("last", F.lead("node").over(w).isNull()).select("way", "i", "node", "x", "y", F.explode(F.when(F.col("cut") & (F.col("part") > 0) & ~F.col("last"), F.array(F.col("part"), F.col("part") + 1)).when(F.col("cut") & (F.col("part") == 0), F.array(F.lit(1).cast("long"))).otherwise(F.array("part"))).alias("part"))
    per = both.groupBy("way", "part").agg(F.sort_array(F.collect_list(F.struct("i", "node", "x", "y"))).alias("p")).where(F.size("p") >= 2)
    seg = graph.ordinals(per.select("way", "part", F.col("p.node").alias("nodes"), F.transform("p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points")), ["way", "part"], "seg")
    return cut(seg.join(ways.drop("nodes"), "way").drop("part"))


def _arms(seg: DataFrame) -> DataFrame:
    """(node, seg, end, sided, angle, name): both ends of each segment with the course to the first point over half a metre away."""
    def arm(end: int) -> Column:
        ids, pts = (F.col("nodes"), F.col("points")) if end == 0 else (F.reverse("nodes"), F.reverse("points"))
        far = F.filter(pts, lambda p: F.pow(p["x"] - pts[0]["x"], 2.0) + F.pow(p["y"] - pts[0]["y"], 2.0) > 0.25)
        angle = F.when(F.size(far) > 0, F.atan2(F.get(far, F.lit(0))["y"] - pts[0]["y"], F.get(far, F.lit(0))["x"] - pts[0]["x"])).otherwise(0.0)
        return F.struct(ids[0].alias("node"), F.lit(end).alias("end"), angle.alias("angle"))

    return seg.select("seg", "sided", "name", F.explode(F.array(arm(0), arm(1))).alias("a")).select("a.node", "seg", "a.end", "sided", "a.angle", "name")


def _corner(vx: Column, vy: Column, nx: Column, ny: Column) -> tuple[Column, Column]:
    """Where a corner lies off its junction: along the sum of two normals, as far as both sides' lines meet, 2.5 offsets at most; along one
    normal where they cancel out."""
    m = F.sqrt(vx * vx + vy * vy)
    far = F.least(2 * OFFSET / F.when(m > 0, m), F.lit(2.5 * OFFSET))
    flat = m * m < 0.09
    return F.when(flat, nx * OFFSET).otherwise(vx / m * far), F.when(flat, ny * OFFSET).otherwise(vy / m * far)


def _inner(points: Column, side: int) -> Column:
    """The points between a segment's ends, moved to a side (1 left, -1 right, 0 not)."""
    inner = F.slice(points, F.lit(2), F.greatest(F.size(points) - 2, F.lit(0)))
    if not side:
        return inner.cast(_POINTS)

    def moved(p: Column, j: Column) -> Column:
        a, b = F.get(points, j), F.get(points, j + 2)
        l0, l1 = F.hypot(p["x"] - a["x"], p["y"] - a["y"]), F.hypot(b["x"] - p["x"], b["y"] - p["y"])
        ux0, uy0, ux1, uy1 = (p["x"] - a["x"]) / l0, (p["y"] - a["y"]) / l0, (b["x"] - p["x"]) / l1, (b["y"] - p["y"]) / l1
        ox, oy = _corner(-uy0 - uy1, ux0 + ux1, -uy0, ux0)
        return F.struct((p["x"] + side * ox).alias("x"), (p["y"] + side * oy).alias("y"))

    return F.transform(inner, moved).cast(_POINTS)


def _drawn(seg: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((key, x, y), (a, b, flags, name, geom)): nodes and edges before contraction; a key is a junction and its corner's number."""
    arms = cut(_arms(seg))
    w = Window.partitionBy("node").orderBy("angle", "seg", "end")
    per = Window.partitionBy("node")
    count = arms.groupBy("node").agg(F.count("*").alias("all"), F.sum(F.when(F.col("sided"), 1).otherwise(0)).alias("k"))
    key = lambda i: F.struct(F.col("node").alias("node"), i.cast("int").alias("i"))
    sided = arms.where("sided").join(count, "node").withColumn("i", F.row_number().over(w) - 1).withColumn("next", F.coalesce(F.lead("angle").over(w), F.first("angle").over(w)))
    plain = F.col("k") <= 1
    sided = cut(sided.withColumn("left", F.when(plain, key(F.lit(-1))).otherwise(key(F.col("i")))).withColumn("right", F.when(plain, key(F.lit(-1))).otherwise(key((F.col("i") - 1 + F.col("k")) % F.col("k")))))
    a, b = F.col("angle"), F.col("next")
    ox, oy = _corner(F.sin(b) - F.sin(a), F.cos(a) - F.cos(b), -F.sin(a), F.cos(a))
    corners = sided.where(~plain).join(places, "node").select(F.col("left").alias("key"), (F.col("x") + ox).alias("x"), (F.col("y") + oy).alias("y"))
    middles = count.where(plain).join(places, "node").select(key(F.lit(-1)).alias("key"), "x", "y")
    # an arm of another way stands at the corner before it
    rest = arms.where("not sided").join(count, "node").join(sided.select("node", F.col("angle").alias("__a"), F.col("i").alias("__i")), "node", "left")
    rest = rest.groupBy("node", "seg", "end").agg(F.first("k").alias("k"), F.max(F.when(F.col("__a") <= F.col("angle"), F.col("__i"))).alias("i"))
    rest = rest.select("seg", "end", F.when(plain, key(F.lit(-1))).otherwise(key(F.coalesce("i", F.col("k") - 1))).alias("at"))
    real = sided.where(~plain).join(places.select("node", "cross"), "node").where("all > k or k >= 3 or cross >= 0").where("k > 2 or i = 0")
    none = F.array().cast(_POINTS)
    crossings = real.select(F.col("right").alias("a"), F.col("left").alias("b"), walking.flags(F.lit(walking.CROSSING), F.when(F.col("cross") >= 0, F.col("cross")).otherwise(3), F.lit(0), F.lit(False)).alias("flags"), "name", none.alias("geom"))
    side = lambda e, c: sided.where(F.col("end") == e).select("seg", F.col("left").alias(f"l{c}"), F.col("right").alias(f"r{c}"))
    busy = seg.where("sided").join(side(0, 0), "seg").join(side(1, 1), "seg")
    flag = lambda walk: walking.flags(F.lit(walking.SIDE), F.col("sub"), F.col(walk), F.col("covered"))
    lefts = busy.select(F.col("l0").alias("a"), F.col("r1").alias("b"), flag("left").alias("flags"), "name", _inner(F.col("points"), 1).alias("geom"))
    rights = busy.select(F.col("r0").alias("a"), F.col("l1").alias("b"), flag("right").alias("flags"), "name", _inner(F.col("points"), -1).alias("geom"))
    at = lambda e: rest.where(F.col("end") == e).select("seg", F.col("at").alias("ab"[e]))
    other = seg.where("not sided").join(at(0), "seg").join(at(1), "seg")
    # a crossing without a name has that of a street it touches
    street = seg.where(F.col("kind").isin(walking.STREET, walking.SIDE) & F.col("name").isNotNull()).select(F.col("name").alias("street"), "way", F.explode("nodes").alias("node")).groupBy("node").agg(F.min_by("street", "way").alias("street"))
    touched = seg.where((F.col("kind") == walking.CROSSING) & F.col("name").isNull()).select("seg", F.posexplode("nodes").alias("i", "node")).join(street, "node").groupBy("seg").agg(F.min_by("street", "i").alias("street"))
    own = other.join(touched, "seg", "left").select("a", "b", walking.flags(F.col("kind"), F.col("sub"), F.lit(0), F.col("covered")).alias("flags"), F.coalesce("name", "street").alias("name"), F.when(F.col("kind") == walking.CROSSING, none).otherwise(_inner(F.col("points"), 0)).alias("geom"))
    edges = lefts.unionByName(rights).unionByName(own).unionByName(crossings)
    return corners.unionByName(middles), edges


def build(ways: DataFrame, places: DataFrame, island: int = ISLAND) -> tuple[DataFrame, DataFrame]:
    """((node, x, y), (edge, a, b, flags, name, geom)): the graph; geom are the points between an edge's ends, a to b.

    A node that joins two edges of equal flags and name, but no crossings, is passed through; a chain that comes back to where it began
    stays two edges, cut before its last one. Edges with both ends at one node go, and so do islands of fewer than `island` edges."""
    nodes, edges = _drawn(_segments(ways, places), places)
    nodes = cut(graph.ordinals(nodes, ["key"], "node"))
    number = lambda k: nodes.select(F.col("key").alias(k), F.col("node").alias(f"__{k}"))
    flat = edges.join(number("a"), "a").join(number("b"), "b").select(F.col("__a").alias("a"), F.col("__b").alias("b"), "flags", "name", "geom")
    flat = cut(graph.ordinals(flat.withColumn("__g", F.xxhash64("geom")).distinct(), ["a", "b", "flags", "name", "__g"], "id").drop("__g"))
    ends = flat.select("id", "flags", "name", F.explode(F.when(F.col("a") == F.col("b"), F.array("a", "a", "a")).otherwise(F.array("a", "b"))).alias("node"))  # a loop can't be passed through
    same = ends.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct("flags", F.coalesce("name", F.lit("\0"))).alias("kinds"), F.first("flags").alias("flags"))
    through = same.where((F.col("n") == 2) & (F.col("kinds") == 1) & (F.col("flags").bitwiseAND(7) != walking.CROSSING)).select("node", F.lit(True).alias("t"))
    # other nodes are ends: there each edge has an end of its own
    mark = lambda k: through.select(F.col("node").alias(k), F.col("t").alias(f"t{k}"))
    loose = flat.join(mark("a"), "a", "left").join(mark("b"), "b", "left")
    end = lambda k, j: F.when(F.col(f"t{k}"), F.col(k)).otherwise(-(F.col("id") * 2 + j) - 1)
    order = cut(graph.chains(loose.select("id", F.lit("").alias("key"), end("a", 0).alias("a"), end("b", 1).alias("b"), F.lit(False).alias("oneway"))))
    each = order.join(flat, "id").join(nodes.select(F.col("node").alias("a"), F.struct("x", "y").alias("pa")), "a").join(nodes.select(F.col("node").alias("b"), F.struct("x", "y").alias("pb")), "b")
    turn = lambda x, y: F.when(F.col("forward"), F.col(x) if isinstance(x, str) else x).otherwise(F.col(y) if isinstance(y, str) else y)
    each = each.select("chain", "pos", "flags", "name", turn("a", "b").alias("from"), turn("b", "a").alias("to"), turn("pb", "pa").alias("p"), turn("geom", F.reverse("geom")).alias("geom"))
    whole = each.groupBy("chain").agg(F.min_by("from", "pos").alias("s"), F.max_by("to", "pos").alias("t"), F.max("pos").alias("last"))
    each = each.join(whole, "chain").withColumn("part", F.when((F.col("s") == F.col("t")) & (F.col("last") > 0) & (F.col("pos") == F.col("last")), 1).otherwise(0))
    one = each.groupBy("chain", "part").agg(F.sort_array(F.collect_list(F.struct("pos", "geom", "p"))).alias("steps"), F.min_by("from", "pos").alias("a"), F.max_by("to", "pos").alias("b"), F.first("flags").alias("flags"), F.first("name").alias("name"))  # of one chain: its own points
    inner = F.flatten(F.transform("steps", lambda s, i: F.when(i < F.size("steps") - 1, F.array_append(s["geom"], s["p"])).otherwise(s["geom"])))
    made = cut(one.where("a <> b").select((F.col("chain") * 2 + F.col("part")).alias("edge"), "a", "b", "flags", "name", inner.alias("geom")))
    held = graph.components(made.select(F.explode(F.array("a", "b")).alias("node")).distinct(), made.select("a", "b"))
    counts = made.join(held, F.col("a") == F.col("node")).groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= island)
    stay = held.join(counts, "component", "left_semi").select("node")
    made = made.join(stay.withColumnRenamed("node", "a"), "a", "left_semi")
    simple = lines.simplified(made.select(F.col("edge").alias("line"), F.posexplode("geom").alias("i", "p")).select("line", "i", "p.x", "p.y"), SIMPLER)
    simple = simple.groupBy("line").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("g")).select(F.col("line").alias("edge"), F.transform("g", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("__g"))
    made = made.join(simple, "edge", "left").select("edge", "a", "b", "flags", "name", F.coalesce("__g", F.array().cast(_POINTS)).alias("geom"))
    return nodes.join(stay, "node", "left_semi").select("node", "x", "y"), made
