"""Map matching of point tracks to segments: Viterbi over a few candidates a point."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from farwheel.operators import edges

SIGMA, BETA, CHANGE = 10.0, 3.0, 6.0


def viterbi(points: DataFrame, segments: DataFrame, radius: float, most: int) -> DataFrame:
    """(vehicle, event_id, pattern_id, pos, metres): the likeliest segment of each point of a track.

    The candidates come from a cell join; only a track's own candidates meet in one task, and its state is two short rows.
    Emission 0.5 (d / SIGMA)^2; staying on a pattern is free but for the jump in position over BETA, a change costs CHANGE."""
    near = edges.nearest_edges(points.select("event_id", "px", "py"), "event_id", segments, ["pattern_id", "pos"], radius, radius, most)
    rows = points.select("vehicle", "ts", "event_id").join(near, "event_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id", "metres", "pattern_id", "pos"], kind="stable")
        first = np.flatnonzero(np.r_[True, pdf.event_id.to_numpy()[1:] != pdf.event_id.to_numpy()[:-1]])
        ends = np.r_[first[1:], len(pdf)]
        pattern, pos, d = (pdf[c].to_numpy() for c in ("pattern_id", "pos", "metres"))
        emission = 0.5 * (d / SIGMA) ** 2
        back = np.full(len(pdf), -1)
        cost = np.zeros(len(pdf))
        for k, (a, b) in enumerate(zip(first, ends, strict=True)):
            cost[a:b] = emission[a:b]
            if k:
                p, q = first[k - 1], ends[k - 1]
                same = pattern[a:b, None] == pattern[None, p:q]
                move = np.where(same, np.abs(pos[a:b, None] - pos[None, p:q]) / BETA, CHANGE)
                total = cost[None, p:q] + move
                best = total.argmin(1)
                back[a:b] = p + best
                cost[a:b] += total[np.arange(b - a), best]
        chosen = []
        if len(pdf):
            at = first[-1] + int(cost[first[-1] :].argmin())
            while at >= 0:
                chosen.append(at)
                at = back[at]
        return pdf.iloc[chosen[::-1]][["vehicle", "event_id", "pattern_id", "pos", "metres"]]

    out = rows.groupBy("vehicle").applyInPandas(run, "vehicle long, event_id long, pattern_id int, pos int, metres double")
    return out.withColumn("metres", F.round("metres", 3))
