"""Paths whose moves are worked out in the unit, against those over a table of moves; moves by blocks of frames."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.operators import synthesis
from cinefold.plans.synthesis import _jump
from pyspark.sql import functions as F


@pytest.mark.parametrize("cells", [7, 1 << 21])
def test_paths_between(spark, monkeypatch, cells):
    monkeypatch.setattr(synthesis, "_CELLS", cells)
    random = np.random.default_rng(2)
    values = [(k, f, round(float(random.normal()), 6)) for k in range(3) for f in range(12 + k)]
    costs = spark.createDataFrame([(k, t, f, float(random.integers(0, 9)) / 8) for k, f, _ in values for t in range(5)], "key long, t int, frame long, cost double")
    moves = [(k, i, j, round(abs(a - b) * (1 if j == i + 1 else 5), 6)) for k, i, a in values for l, j, b in values if k == l]  # noqa: E741
    want = synthesis.paths(costs, spark.createDataFrame(moves, "key long, i long, j long, cost double")).collect()
    assert sorted(map(tuple, synthesis.paths_between(costs, spark.createDataFrame(values, "key long, frame long, value double"), _jump).collect())) == sorted(map(tuple, want))


def test_moves_of_one_key_are_many_tasks(spark):
    frames = spark.range(400).select(F.lit(1).alias("key"), F.col("id").alias("frame"))
    found = synthesis.chain_moves(frames, 50)
    parts = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 160_000 and max(parts) < 40_000
    free = {(r["i"], r["j"]) for r in found.where("cost = 0").collect()}
    assert free == {(i, i + 1) for i in range(399)} | {(0, 0), (399, 0), (399, 1)}
