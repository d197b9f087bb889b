"""The drawn streets and tracks give every stage of map matching something to do."""

from __future__ import annotations

from pyspark.sql import functions as F

from farwheel import queries_drawn as q
from farwheel.operators import snapping

SF = "/root/testdata/sf0.001"


def test_bridges_and_spurs_change_the_paths(spark):
    s = q._stages(spark, SF)
    filled = q._bridged(s)
    assert filled.where("path is not null").count() and {"bridge off shape", "no route across gap"} <= {r.cause for r in filled.collect()}
    path = lambda f: snapping.assembled(s["at"], s["match"], s["drawn"], f, s["roads"])
    whole, without = path(filled), path(filled.withColumn("path", F.lit(None).cast("array<bigint>")))
    changed = whole.exceptAll(without).select("line").distinct()
    assert changed.exceptAll(filled.where("path is not null").select("line").distinct()).isEmpty() and not changed.isEmpty()
    assert not whole.exceptAll(snapping.collapsed(whole, s["roads"], s["shapes"])).isEmpty()


def test_streets_hold_what_they_say(spark):
    roads = q.streets(spark, SF).toPandas()
    assert roads.edge.is_unique and len(roads[["a", "ax", "ay"]].drop_duplicates()) == roads.a.nunique()
    long = roads[roads.metres > 100]
    level = long[(long.ay == long.by) & (long.ax < long.bx)]
    assert {(x, y) for x, y in zip(level.ax, level.ay)} & {(x, y + 18) for x, y in zip(level.ax, level.ay)}  # a second carriageway
    assert roads.penalty.max() >= 3


def test_a_match_tells_what_later_stages_ask(spark):
    """Where edges change and what begins and ends a run, so that later stages read a few rows a line and no sample again."""
    s = q._stages(spark, SF)
    rows = s["match"].orderBy("line", "k").collect()
    ends = {r.edge: (r.a, r.b, r.metres) for r in s["roads"].collect()}
    along = {(r.line, r.k): r.along for r in s["at"].collect()}
    runs, of_line = {}, {}
    for r in rows:
        runs.setdefault((r.line, r.run), []).append(r)
        of_line.setdefault(r.line, []).append(r)
    for (line, _), mine in runs.items():
        assert (mine[0].lo, mine[0].hi) == (mine[0].k, mine[-1].k) and all(r.lo is None for r in mine[1:])
        assert (mine[0].along_lo, mine[0].along_hi) == (along[line, mine[0].k], along[line, mine[-1].k])
        whole = of_line[line]
        assert (mine[0].opens, mine[0].closes) == (whole[0].t if whole[0] is mine[0] else None, whole[-1].t if whole[-1] is mine[-1] else None)
        assert mine[0].moved and mine[0].was is None
        for p, r in zip(mine, mine[1:]):
            assert r.a == ends[r.edge][0] and r.was == ends[p.edge][1]
            assert r.moved == (r.edge != p.edge or (p.t - r.t) * ends[r.edge][2] > 3)
    gaps = snapping.run_gaps(s["match"], s["drawn"], s["roads"])
    assert gaps.count() == len(runs) - len(of_line)
    assert "Generate" not in gaps._jdf.queryExecution().optimizedPlan().toString()  # no resampling


def test_stops_are_placed_within_their_line(spark, monkeypatch):
    """No pair of stop and segment is a row, and a long line is reckoned in parts; a line without a path or without stops gives none."""
    shapes = q.tracks(spark, SF)
    stops = q.riders_stops(shapes).where("line % 10 <> 3")
    rows = lambda: sorted(map(tuple, snapping.placed(shapes.where("line % 10 <> 4"), stops).collect()))
    monkeypatch.setattr(snapping, "near_segments", None)
    whole = rows()
    assert {r[0] % 10 for r in whole} == {0, 1, 2, 5, 6, 7, 8, 9}
    monkeypatch.setattr(snapping, "PAIRS", 1)
    assert rows() == whole
