"""Chains of segments by pointer jumping, against walking them one by one."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from farwheel.operators import features, graph


def plain(segments):
    """Chains by a walk: a set of segment lists, each with its ways."""
    out = set()
    groups = {}
    for s in segments:
        groups.setdefault((s[1], s[4]), []).append(s)
    for (_, oneway), segs in groups.items():
        arcs = {(i, True): (a, b) for i, _, a, b, _ in segs}
        if not oneway:
            arcs |= {(i, False): (b, a) for i, _, a, b, _ in segs}
        ins, outs = {}, {}
        for k, (a, b) in arcs.items():
            outs.setdefault(a, []).append(k)
            ins.setdefault(b, []).append(k)
        want = 1 if oneway else 2
        after = {}
        for k, (_, b) in arcs.items():
            if len(ins.get(b, [])) == want == len(outs.get(b, [])):
                nxt = [x for x in outs[b] if x[0] != k[0]]
                if nxt:
                    after[k] = nxt[0]
        heads = set(arcs) - set(after.values())
        done = set()
        for head in sorted(heads):
            walk = [head]
            while walk[-1] in after:
                walk.append(after[walk[-1]])
            done |= {k[0] for k in walk}
            back = tuple((i, not w) for i, w in reversed(walk))
            out.add(min(tuple(walk), back, key=lambda c: (c[0][0], not c[0][1])) if not oneway else tuple(walk))
        for i in sorted({k[0] for k in arcs} - done):
            if i not in done:
                walk = [(i, True)]
                while after[walk[-1]] != walk[0]:
                    walk.append(after[walk[-1]])
                done |= {k[0] for k in walk}
                out.add(tuple(walk))
    return out


def told(spark, segments, schema="id long, key string, a long, b long, oneway boolean"):
    got = {}
    for r in graph.chains(spark.createDataFrame(segments, schema)).collect():
        got.setdefault(r.chain, []).append((r.pos, r.id, r.forward))
    out = set()
    for chain, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(len(rows))) and rows[0][1] == chain
        out.add(tuple((i, f) for _, i, f in rows))
    return out


def test_chains_of_every_kind(spark):
    line = [(i, "k", i, i + 1, False) for i in range(40)]
    ring = [(100 + i, "k", 200 + i, 200 + (i + 1) % 7, False) for i in range(7)]
    oneway = [(300 + i, "k", 400 + i, 401 + i, True) for i in range(9)] + [(320, "k", 409, 400, True)]
    fork = [(500, "f", 0, 1, False), (501, "f", 1, 2, False), (502, "f", 1, 3, False), (503, "f", 3, 4, False), (504, "g", 3, 9, False)]
    lone = [(600, "k", 900, 901, True), (601, "z", 900, 901, False)]
    segments = line + ring + oneway + fork + lone
    got = told(spark, segments)
    assert got == plain(segments)
    assert tuple((i, True) for i in range(40)) in got and {len(c) for c in got} == {40, 7, 10, 1, 2}


def test_random_graphs(spark):
    rng = random.Random(7)
    pairs = set()
    while len(pairs) < 160:
        a, b = rng.sample(range(90), 2)
        pairs.add((rng.choice("pq"), min(a, b), max(a, b)))
    segments = [(i, k, *((a, b) if rng.random() < 0.5 else (b, a)), rng.random() < 0.5) for i, (k, a, b) in enumerate(sorted(pairs))]
    assert told(spark, segments) == plain(segments)


def test_drawn_features(spark):
    nodes = spark.createDataFrame([(i, 45.0, 7.0 + i / 1000) for i in range(8)], "node long, lat double, lon double")
    both = [(3, i, i + 1, r) for i in range(3) for r in ("1", "2")] + [(3, i + 1, i, "1") for i in range(3)]
    back = [(3, i + 1, i, "9") for i in range(4, 7)]
    got = features.chain_features(spark.createDataFrame([*both, *back, (3, 5, 5, "1")], "mode int, from_node long, to_node long, route string"), nodes)
    rows = {r.routes: r for r in got.withColumn("n", F.col("n")).collect()}
    assert set(rows) == {"1,2", "9"} and rows["1,2"].n == 3 and not rows["1,2"].one_way and rows["9"].one_way
    assert [p[0] for p in json.loads(rows["9"].line)["coordinates"]] == [7.007, 7.006, 7.005, 7.004]  # the way it is driven
