"""Costs of the walking graph's edges, by their flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of edges; crossings in metres by type (signals, zebra, uncontrolled, unmarked); factors of paths (path,
#: mapped sidewalk, pedestrian zone, rough track), of minor streets (residential, living street, service lane), and of busy roads'
#: sides by class (tertiary, secondary, primary) and sidewalk (unknown, present, none).
PATH, STREET, SIDE, STEPS, CROSSING = range(5)
CROSSINGS = [20.0, 25.0, 30.0, 120.0]
PATHS = [1.0, 1.0, 0.95, 1.3]
STREETS = [1.0, 0.95, 1.3]
SIDES = [[1.15, 1.0, 1.6], [1.25, 1.05, 2.0], [1.4, 1.1, 2.5]]
STEP_FACTOR, COVERED = 3.0, 0.9


def flags(kind: Column, sub: Column, sidewalk: Column, covered: Column) -> Column:
    """kind (3 bits), sub (2), sidewalk (2), covered (1)."""
    return kind.bitwiseOR(F.shiftleft(sub, 3)).bitwiseOR(F.shiftleft(sidewalk, 5)).bitwiseOR(F.when(covered, 128).otherwise(0)).cast("int")


def _of(values: list[float], i: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), F.least(i, F.lit(len(values) - 1)).cast("int") + 1)


def edge_cost(metres: Column, flag: Column) -> Column:
    """Search cost in metres of an edge with these flags."""
    kind, sub, sidewalk = flag.bitwiseAND(7), F.shiftright(flag, 3).bitwiseAND(3), F.shiftright(flag, 5).bitwiseAND(3)
    side = F.element_at(F.array(*(_of(row, sidewalk) for row in SIDES)), F.least(sub, F.lit(2)).cast("int") + 1)
    factor = F.when(kind == PATH, _of(PATHS, sub)).when(kind == STREET, _of(STREETS, sub)).when(kind == SIDE, side).when(kind == STEPS, F.lit(STEP_FACTOR)).otherwise(F.lit(1.0))
    factor = factor * F.when(flag.bitwiseAND(128) != 0, F.lit(COVERED)).otherwise(F.lit(1.0))
    return metres * factor + F.when(kind == CROSSING, _of(CROSSINGS, sub)).otherwise(F.lit(0.0))
