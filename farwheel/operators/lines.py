"""Polylines: running length, cuts, turns, simplification, and audits of drawn lines, as DataFrame operators in plane metres.

A line is rows (line, i, x, y) in order of i; windows run within a line, and a line's points are few."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from farwheel.functions import geo

#: Audits, in metres and degrees: legs of a fold, its turn, how far along a line may cross itself, when lines touch, the cell.
FOLD_LEAST, FOLD_MOST, FOLD_DEGREES, LOOP, TOUCH, CELL = 2.0, 15.0, 150.0, 80.0, 1.0, 25.0


def _in_line() -> Window:
    return Window.partitionBy("line").orderBy("i")


def measured(points: DataFrame) -> DataFrame:
    """`points` with `along`, the metres from the line's start."""
    hop = F.hypot(F.col("x") - F.lag("x").over(_in_line()), F.col("y") - F.lag("y").over(_in_line()))
    return points.withColumn("__hop", F.coalesce(hop, F.lit(0.0))).withColumn("along", F.sum("__hop").over(_in_line().rowsBetween(Window.unboundedPreceding, 0))).drop("__hop")


def segments(points: DataFrame) -> DataFrame:
    """(line, i, ax, ay, bx, by): the segment that ends at point i."""
    ahead = points.select("line", "i", F.lag("x").over(_in_line()).alias("ax"), F.lag("y").over(_in_line()).alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    return ahead.where("ax is not null")


def split_at(points: DataFrame, cuts: DataFrame) -> DataFrame:
    """(line, part, i, x, y): each line cut at (line, cut) metres; both parts hold the place of the cut, as i of the point before it.

    `part` 0 is what lies behind, 1 ahead; a cut past the end leaves the last point ahead."""
    m = measured(points).join(cuts, "line")
    nxt = m.withColumn("nx", F.lead("x").over(_in_line())).withColumn("ny", F.lead("y").over(_in_line())).withColumn("na", F.lead("along").over(_in_line()))
    last = nxt.where(F.col("along") <= F.col("cut")).groupBy("line").agg(F.max(F.struct("i", "x", "y", "along", "nx", "ny", "na", "cut")).alias("v"))
    t = F.when(F.col("v.na") > F.col("v.along"), F.least(F.lit(1.0), (F.col("v.cut") - F.col("v.along")) / (F.col("v.na") - F.col("v.along")))).otherwise(F.lit(0.0))
    at = last.select("line", F.col("v.i").alias("vi"), F.coalesce(F.col("v.x") + t * (F.col("v.nx") - F.col("v.x")), F.col("v.x")).alias("x"), F.coalesce(F.col("v.y") + t * (F.col("v.ny") - F.col("v.y")), F.col("v.y")).alias("y"), F.col("v.nx").isNotNull().alias("inner"))
    both = points.join(at.select("line", "vi"), "line")
    part = lambda k, rows: rows.select("line", F.lit(k).alias("part"), "i", "x", "y")
    edge = at.select("line", F.col("vi").alias("i"), "x", "y", "inner")
    return (
        part(0, both.where("i <= vi")).unionByName(part(0, edge.where("inner"))).unionByName(part(1, edge)).unionByName(part(1, both.where("i > vi")))
    )


def turns(points: DataFrame) -> DataFrame:
    """(line, i, before, after, turn): lengths of the segments at each inner point and the angle between them, over -180 to 180."""
    w = _in_line()
    ax, ay = F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)
    bx, by = F.lead("x").over(w) - F.col("x"), F.lead("y").over(w) - F.col("y")
    d = points.select("line", "i", "x", "y", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by")).where("ax is not null and bx is not null")
    turn = 0.0 - F.degrees(F.atan2(F.col("ax") * F.col("by") - F.col("ay") * F.col("bx"), F.col("ax") * F.col("bx") + F.col("ay") * F.col("by")))
    return d.select("line", "i", "x", "y", F.hypot("ax", "ay").alias("before"), F.hypot("bx", "by").alias("after"), turn.alias("turn"))


def local_minima(candidates: Column, stretch: float = 30.0) -> Column:
    """Of array<struct<pos, dist>> sorted by pos: one for each stretch of metres, the nearest."""
    kind = "array<struct<pos:double,dist:double>>"

    def put(kept: Column, c: Column) -> Column:
        last = F.element_at(kept, -1)
        near = (F.size(kept) > 0) & (c["pos"] - F.when(F.size(kept) > 0, last["pos"]) < stretch)
        better = F.when(c["dist"] < F.when(F.size(kept) > 0, last["dist"]), F.array_append(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), c)).otherwise(kept)
        return F.when(near, better).otherwise(F.array_append(kept, c))

    rows = F.transform(candidates, lambda c: F.struct(c["pos"].cast("double").alias("pos"), c["dist"].cast("double").alias("dist")))
    return F.aggregate(rows, F.array().cast(kind), put)


def simplified(points: DataFrame, tolerance: float = 0.7) -> DataFrame:
    """The points that Douglas and Peucker keep: no other lies over `tolerance` metres off the line through them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        x, y = pdf.x.to_numpy(), pdf.y.to_numpy()
        keep = np.zeros(len(pdf), bool)
        keep[[0, -1]] = True
        stack = [(0, len(pdf) - 1)]
        while stack:
            a, b = stack.pop()
            if b - a < 2:
                continue
            dx, dy = x[b] - x[a], y[b] - y[a]
            px, py = x[a + 1 : b] - x[a], y[a + 1 : b] - y[a]
            size = dx * dx + dy * dy
            t = np.clip((px * dx + py * dy) / size, 0, 1) if size else np.zeros(b - a - 1)
            off = np.hypot(px - t * dx, py - t * dy)
            k = int(off.argmax())
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                stack += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf[keep]

    return points.groupBy("line").applyInPandas(run, points.schema)


def ends(points: DataFrame) -> DataFrame:
    """(x, y), rounded to a metre: where lines begin and end. Junctions, at which audits see no fault."""
    first = points.groupBy("line").agg(F.min(F.struct("i", "x", "y")).alias("a"), F.max(F.struct("i", "x", "y")).alias("b"))
    one = first.select(F.explode(F.array("a", "b")).alias("p"))
    return one.select(F.round("p.x").alias("jx"), F.round("p.y").alias("jy")).distinct()


def folds(points: DataFrame, least: float = FOLD_LEAST, most: float = FOLD_MOST, degrees: float = FOLD_DEGREES) -> DataFrame:
    """(line, i, degrees): spikes, where a line turns back between two short legs, but not at junctions."""
    t = turns(points).where((F.least("before", "after") >= least) & (F.greatest("before", "after") <= most) & (F.abs("turn") > degrees))
    free = t.join(ends(points), (F.round("x") == F.col("jx")) & (F.round("y") == F.col("jy")), "left_anti")
    return free.select("line", "i", F.round(F.abs("turn")).cast("int").alias("degrees"))


def self_crossings(points: DataFrame, loop: float = LOOP) -> DataFrame:
    """(line, i, j): segments of one line that cross within `loop` metres along it, with no junction in between."""
    m = measured(points)
    seg = segments(points).join(m.select("line", "i", "along"), ["line", "i"])
    free = m.join(ends(points), (F.round("x") == F.col("jx")) & (F.round("y") == F.col("jy")), "left_semi").select("line", F.col("i").alias("k"))
    cell = F.floor(F.col("along") / loop)
    one = seg.withColumn("cell", cell)
    two = seg.withColumn("cell", F.explode(F.array(cell, cell - 1)))  # a later segment within the loop stands in this cell or the next
    two = two.select("line", "cell", F.col("i").alias("j"), F.col("along").alias("later"), *(F.col(c).alias(d) for c, d in zip(("ax", "ay", "bx", "by"), ("cx", "cy", "dx", "dy"), strict=True)))
    both = one.join(two, ["line", "cell"]).where((F.col("j") >= F.col("i") + 2))
    start = F.col("later") - F.hypot(F.col("dx") - F.col("cx"), F.col("dy") - F.col("cy"))
    near = both.where((start - F.col("along") <= loop) & geo.crosses(*(F.col(c) for c in ("ax", "ay", "bx", "by", "cx", "cy", "dx", "dy"))))
    met = near.join(free, "line", "left").groupBy("line", "i", "j").agg(F.max(F.coalesce((F.col("k") >= F.col("i")) & (F.col("k") < F.col("j")), F.lit(False))).alias("junction"))
    return met.where("not junction").select("line", "i", "j")


def near_lines(vertices: DataFrame, drawn: DataFrame, touch: float = TOUCH, cell: float = CELL) -> DataFrame:
    """(line, i, near): for each vertex (line, i, x, y) the drawn lines within `touch` metres; a segment is spread over the cells of its box."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - touch) / cell).cast("int"), F.floor((hi + touch) / cell).cast("int")))
    seg = segments(drawn).withColumnRenamed("line", "drawn").drop("i")
    seg = seg.withColumn("cx", spread(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("cy", spread(F.least("ay", "by"), F.greatest("ay", "by")))
    at = vertices.select("line", "i", "x", "y", F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy"))
    metres = geo.project(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))["metres"]
    hit = at.join(seg, ["cx", "cy"]).where(metres <= touch).groupBy("line", "i").agg(F.array_sort(F.collect_set("drawn")).alias("near"))
    return vertices.select("line", "i", "x", "y").join(hit, ["line", "i"], "left").withColumn("near", F.coalesce("near", F.array().cast("array<bigint>")))


def joined_lines(drawn: DataFrame, touch: float = TOUCH, cell: float = CELL) -> DataFrame:
    """(a, b), a < b: drawn lines that come within `touch` metres of each other."""
    spread = lambda lo, hi: F.explode(F.sequence(F.floor((lo - touch) / cell).cast("int"), F.floor((hi + touch) / cell).cast("int")))
    seg = segments(drawn).withColumn("cx", spread(F.least("ax", "bx"), F.greatest("ax", "bx"))).withColumn("cy", spread(F.least("ay", "by"), F.greatest("ay", "by")))
    other = seg.select(F.col("line").alias("b"), "cx", "cy", *(F.col(c).alias(d) for c, d in zip(("ax", "ay", "bx", "by"), ("px", "py", "qx", "qy"), strict=True)))
    one, two = ("ax", "ay", "bx", "by"), ("px", "py", "qx", "qy")
    far = lambda p, s: geo.project(*(F.col(c) for c in (*p, *s)))["metres"]
    apart = F.least(far(one[:2], two), far(one[2:], two), far(two[:2], one), far(two[2:], one))
    meet = geo.crosses(*(F.col(c) for c in (*one, *two))) | (apart <= touch)
    return seg.join(other, ["cx", "cy"]).where(F.col("line") < F.col("b")).where(meet).select(F.col("line").alias("a"), "b").distinct()


def gaps(vertices: DataFrame, drawn: DataFrame, touch: float = TOUCH) -> DataFrame:
    """(line, i, kind): hops of `vertices` that no one drawn line covers ('missing'), and places where the lines of two hops in a
    row are different ones that don't touch ('joint')."""
    near = near_lines(vertices, drawn, touch)
    w = _in_line()
    moved = near.withColumn("was", F.lag("near").over(w)).withColumn("px", F.lag("x").over(w)).withColumn("py", F.lag("y").over(w))
    moved = moved.where("was is not null and not (px = x and py = y)").withColumn("cur", F.array_intersect("was", "near"))
    moved = moved.withColumn("before", F.lag("cur").over(w)).withColumn("from_i", F.lag("i").over(w))
    missing = moved.where(F.size("cur") == 0).select("line", "i", F.lit("missing").alias("kind"))
    doubt = moved.where((F.size("cur") > 0) & (F.size("before") > 0) & ~F.arrays_overlap("cur", "before"))
    pairs = doubt.select("line", "i", F.explode("before").alias("p"), "cur").select("line", "i", "p", F.explode("cur").alias("q"))
    pairs = pairs.select("line", "i", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    fine = pairs.join(joined_lines(drawn, touch), ["a", "b"], "left_semi").select("line", "i").distinct()
    joint = doubt.join(fine, ["line", "i"], "left_anti").select("line", F.col("from_i").alias("i"), F.lit("joint").alias("kind"))
    return missing.unionByName(joint)


def longest_first(lines: DataFrame) -> DataFrame:
    """(owner, line) of (owner, line, size, stops): an owner's longest line, and of the others, longest first, those that stand at a
    stop that none taken before does."""
    kind = "struct<covered:array<bigint>,taken:array<bigint>>"
    item = F.struct((-F.col("size")).alias("k"), "line", "stops")
    start = F.struct(F.array().cast("array<bigint>").alias("covered"), F.array().cast("array<bigint>").alias("taken")).cast(kind)

    def put(acc: Column, p: Column) -> Column:
        new = (F.size(acc["covered"]) == 0) | (F.size(F.array_except(p["stops"], acc["covered"])) > 0)
        grown = F.struct(F.array_union(acc["covered"], p["stops"]).alias("covered"), F.array_append(acc["taken"], p["line"]).alias("taken"))
        return F.when(new, grown).otherwise(acc)

    per = lines.groupBy("owner").agg(F.sort_array(F.collect_list(item)).alias("all"))
    return per.select("owner", F.explode(F.aggregate("all", start, put, lambda a: a["taken"])).alias("line"))


def connectors(stops: DataFrame, snapped: DataFrame, least: float = 3.0) -> DataFrame:
    """(stop_id, ax, ay, bx, by): from each stop (stop_id, x, y) to where lines place it (stop_id, x, y), if `least` metres away; one
    a metre of places."""
    both = stops.select("stop_id", F.col("x").alias("ax"), F.col("y").alias("ay")).join(snapped.select("stop_id", F.col("x").alias("bx"), F.col("y").alias("by")), "stop_id")
    far = both.where(F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")) >= least)
    return far.groupBy("stop_id", F.round("bx").alias("kx"), F.round("by").alias("ky")).agg(F.min(F.struct("bx", "by")).alias("b"), F.first("ax").alias("ax"), F.first("ay").alias("ay")).select("stop_id", "ax", "ay", "b.bx", "b.by")


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(1))


def varint_hex(z: Column) -> Column:
    """The bytes of a varint of up to 35 bits, in hex."""
    out = []
    for i in range(5):
        low = F.shiftright(z, 7 * i).bitwiseAND(127)
        more = z >= F.lit(1 << (7 * (i + 1)))
        byte = F.lpad(F.hex(low.bitwiseOR(F.when(more, 128).otherwise(0))), 2, "0")
        out.append(byte if i == 0 else F.when(z >= F.lit(1 << (7 * i)), byte).otherwise(""))
    return F.concat(*out)


def resample(points: DataFrame, step: float = 15.0) -> DataFrame:
    """(line, k, x, y, along): each line's start, a place every `step` metres along it, and its end if over a metre beyond the last."""
    w = _in_line()
    m = measured(points)
    hop = m.withColumn("nx", F.lead("x").over(w)).withColumn("ny", F.lead("y").over(w)).withColumn("na", F.lead("along").over(w))
    hop = hop.where("na > along")
    first, last = F.floor(F.col("along") / step) + 1, F.floor(F.col("na") / step)
    inner = hop.where(first <= last).withColumn("k", F.explode(F.sequence(first, last))).withColumn("f", (F.col("k") * step - F.col("along")) / (F.col("na") - F.col("along")))
    inner = inner.select("line", "k", (F.col("x") + F.col("f") * (F.col("nx") - F.col("x"))).alias("x"), (F.col("y") + F.col("f") * (F.col("ny") - F.col("y"))).alias("y"), (F.col("k") * F.lit(float(step))).alias("along"))
    ends_ = m.groupBy("line").agg(F.min(F.struct("i", "x", "y", "along")).alias("a"), F.max(F.struct("i", "x", "y", "along")).alias("b"))
    start = ends_.select("line", F.lit(0).cast("long").alias("k"), "a.x", "a.y", F.lit(0.0).alias("along"))
    whole = F.floor(F.col("b.along") / step)
    end = ends_.where(F.col("b.along") - whole * step > 1).select("line", (whole + 1).alias("k"), "b.x", "b.y", "b.along")
    return start.unionByName(inner).unionByName(end)
