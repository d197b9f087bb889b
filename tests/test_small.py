"""Queries without SQL that are small enough to be told by hand."""

from __future__ import annotations

import json
import math
import os
import random

import pytest

from farwheel.streaming import live

SF = "/root/testdata/sf0.001"


def test_headings_are_smoothed_as_a_weighted_sum(spark):
    """Closed form: the n-th mean vector is the sum of k (1 - k)^(n - i) of the i-th, the first with (1 - k)^n."""
    rng = random.Random(2)
    rows = [(v, i, i, float(rng.choice([350, 355, 0, 5, 10, 180, 181]) if v else 90 + 0.2 * (i % 3))) for v in range(3) for i in range(30)]
    got = {}
    for r in live.smooth_headings(spark.createDataFrame(rows, "vehicle long, ts long, event_id long, heading double")).collect():
        got.setdefault(r.vehicle, []).append((r.event_id, r.heading))
    for v in range(3):
        mine, want, last = [math.radians(r[3]) for r in rows if r[0] == v], [], None
        for n in range(30):
            weights = [0.65**n] + [0.35 * 0.65 ** (n - i) for i in range(1, n + 1)]
            x, y = (sum(w * f(a) for w, a in zip(weights, mine[: n + 1], strict=True)) for f in (math.sin, math.cos))
            h = math.degrees(math.atan2(x, y)) % 360
            if last is None or min(abs(h - last), 360 - abs(h - last)) >= 1:
                last = h
                want.append((n, h))
        own = sorted(got[v])
        assert [e for e, _ in own] == [e for e, _ in want] and all(abs(a - b) < 1e-3 or abs(abs(a - b) - 360) < 1e-3 for (_, a), (_, b) in zip(own, want, strict=True))
    assert len(got[0]) == 1  # jitter of less than a degree is told once


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_widget_payload_is_the_boards_first_twelve(spark):
    from farwheel import catalog
    from farwheel.queries_groups import board

    rows = {}
    for r in board(spark, SF).select("stop_id", "expected", "trip_id", "pos").collect():
        rows.setdefault(r.stop_id, []).append((r.expected, r.trip_id, r.pos))
    got = {r.stop_id: json.loads(r.payload) for r in catalog.QUERIES["SNK-12_widget_payload"](spark, SF).collect()}
    assert set(got) == set(rows)
    for stop, own in rows.items():
        assert [(x["trip_id"], x["expected"]) for x in got[stop]] == [(t, e) for e, t, _ in sorted(own)[:12]]
