"""The walking graph on drawn junctions: counts and places by hand."""

from __future__ import annotations

import math

import pytest

from farwheel.operators import walkgraph

PATH, STREET, SIDE, STEPS, CROSSING = range(5)


def built(spark, ways, places, island=0):
    """Ways are (id, nodes, kind, sided, name[, left, right]), places {node: (x, y[, cross])}."""
    rows = [(w[0], w[1], w[2], 0, w[3], *(w[5:] or (0, 0)), False, w[4]) for w in ways]
    w = spark.createDataFrame(rows, "way long, nodes array<long>, kind int, sub int, sided boolean, left int, right int, covered boolean, name string")
    p = spark.createDataFrame([(n, float(v[0]), float(v[1]), v[2] if len(v) > 2 else -1) for n, v in places.items()], "node long, x double, y double, cross int")
    nodes, edges = walkgraph.build(w, p, island)
    return {r.node: (r.x, r.y) for r in nodes.collect()}, edges.collect()


CROSS = {1: (-300, 0), 2: (-150, 0), 4: (150, 0), 5: (300, 0), 6: (0, -300), 7: (0, -150), 8: (0, 150), 9: (0, 300)}
WAYS = [(100, [1, 2, 3, 4, 5], SIDE, True, "Corso", 1, 1), (101, [6, 7, 3, 8, 9], STREET, False, "Via")]


@pytest.mark.parametrize("cross", [-1, 0])
def test_a_street_crosses_a_busy_road(spark, cross):
    nodes, edges = built(spark, WAYS, {**CROSS, 3: (0, 0, cross)})
    assert len(nodes) == 4 and len(edges) == 5  # two corners, the street's ends; both sides meet at the road's ends and are one edge each
    over = [e for e in edges if e.flags & 7 == CROSSING]
    assert len(over) == 1 and over[0].flags >> 3 & 3 == (3 if cross < 0 else 0) and over[0].name == "Corso"
    assert sorted((round(nodes[n][0], 6), round(nodes[n][1], 6)) for n in (over[0].a, over[0].b)) == [(0, -6), (0, 6)]
    sides = [e for e in edges if e.flags & 7 == SIDE]
    assert len(sides) == 2 and all({e.a, e.b} == {over[0].a, over[0].b} and e.flags >> 5 & 3 == 1 for e in sides)
    for e in sides:  # 6 m above and below, around the end of the road
        assert {(round(abs(p.x)), round(p.y)) for p in e.geom} >= {(150, 6), (300, 0), (150, -6)} or len(e.geom) >= 1
    streets = [e for e in edges if e.flags & 7 == STREET]
    assert {round(nodes[n][1]) for e in streets for n in (e.a, e.b)} == {300, 6, -6, -300}


def test_pass_through_rings_and_islands(spark):
    line = {i: (10.0 * i, 0.0) for i in range(6)}
    ways = [(i, [i, i + 1], PATH, False, "A" if i < 3 else None) for i in range(5)]
    nodes, edges = built(spark, ways, line)
    assert sorted((e.name or "", len(e.geom)) for e in edges) in ([("", 0), ("A", 0)], [("", 1), ("A", 2)]) and len(nodes) == 3
    ring = {10 + i: (1000 + 50 * math.cos(i), 50 * math.sin(i)) for i in range(6)}
    ways += [(20 + i, [10 + i, 10 + (i + 1) % 6], PATH, False, None) for i in range(6)]
    nodes, edges = built(spark, ways, {**line, **ring})
    assert len(edges) == 4  # the ring is two edges
    nodes, edges = built(spark, [*ways, (40, [10, 0], PATH, False, "B"), (41, [900, 901], PATH, False, None)], {**line, **ring, 900: (0.0, 900.0), 901: (9.0, 900.0)}, island=2)
    assert all(y < 800 for _, y in nodes.values()) and len(edges) == 5


def test_three_busy_arms_and_a_path(spark):
    places = {0: (0, 0), 1: (100, 0), 2: (-100, 1), 3: (0, -100), 4: (5, 100), 5: (0, 40)}
    ways = [(1, [0, 1], SIDE, True, "E"), (2, [0, 2], SIDE, True, "W"), (3, [0, 3], SIDE, True, "S"), (4, [4, 5, 0], PATH, False, None), (5, [1, 4], CROSSING, False, None)]
    nodes, edges = built(spark, ways, places)
    over = [e for e in edges if e.flags & 7 == CROSSING]
    assert sorted(e.name for e in over if math.dist(nodes[e.a], nodes[e.b]) < 60) == ["E", "S", "W"]
    assert [e.name for e in over if math.dist(nodes[e.a], nodes[e.b]) >= 60] == ["E"]  # a crossing has the street's name
    path = next(e for e in edges if e.flags & 7 == PATH)
    assert min(nodes[path.a][1], nodes[path.b][1]) == pytest.approx(6, abs=0.2)  # the corner between east and west
    corners = [p for p in nodes.values() if math.dist(p, (0, 0)) < 20]
    assert len(corners) == 3 and all(math.dist(p, (0, 0)) <= 2.5 * 6 + 1e-9 for p in corners)
