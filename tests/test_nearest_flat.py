"""Nearest points in the plane by cells of a grid, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.operators import distance
from pyspark.sql import functions as F

RANDOM = np.random.default_rng(6)
EVEN = RANDOM.normal(size=(400, 2))
CASES = {
    "even": (EVEN, EVEN + 0.01),
    "copies and ties": (np.round(EVEN, 1), np.round(EVEN, 1)),
    "one far off": (np.vstack((EVEN, [[1e6, -1e6], [np.nan, 0]])), np.vstack((EVEN, [[3e6, 0], [np.inf, 0]]))),
    "on a line": (EVEN * [1, 0], EVEN[::-1] * [1, 0]),
    "one place": (EVEN, EVEN[:1]),
    "none": (EVEN, EVEN[:0]),
}


@pytest.mark.parametrize("crowd", [20_000, 3])
@pytest.mark.parametrize("case", CASES)
def test_nearest_flat(spark, monkeypatch, case, crowd):
    monkeypatch.setattr(distance, "CROWD", crowd)
    sides = [spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(points)], "frame long, x double, y double") for points in CASES[case]]
    packed = [s.select("frame", F.array("x", "y").alias("pixels")) for s in sides]
    want = {tuple(r) for r in distance.nearest(*packed, 1).select("frame", "neighbour", "d2").collect()} if len(CASES[case][1]) else set()
    assert {tuple(r) for r in distance.nearest_flat(*sides).collect()} == want


def test_few_pairs_are_looked_at(spark, monkeypatch):
    """No point of an even cloud is left for the comparison with all."""
    called = []
    monkeypatch.setattr(distance, "nearest", lambda *a, **k: called.append(1))
    points = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(EVEN)], "frame long, x double, y double")
    assert distance.nearest_flat(points, points).where("frame = neighbour AND d2 = 0").count() == len(EVEN) and not called
