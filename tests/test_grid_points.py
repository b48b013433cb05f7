"""Points of a grid in triangles: nothing goes through the driver, and every triangle's points are found."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.functions import boxes
from cinefold.plans.shapes import grid_points
from compare import SMALL
from pyspark.sql import functions as F


def test_no_broadcast(spark):
    found = grid_points(spark, SMALL)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("spacing", [1.0, 0.7])
def test_several_triangles_a_key(spark, spacing):
    random = np.random.default_rng(4)
    rows = [(k % 3, *random.uniform(-6, 6, 6).tolist()) for k in range(9)]
    point = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    table = spark.createDataFrame(rows, "key long, ax double, ay double, bx double, by_ double, cx double, cy double")
    triangles = table.select("key", point("ax", "ay").alias("a"), point("bx", "by_").alias("b"), point("cx", "cy").alias("c"))
    want = set()
    for key in range(3):
        own = np.array([r[1:] for r in rows if r[0] == key]).reshape(-1, 3, 2)
        low, high = (np.where(v > 0, 1.0, -1.0) * np.ceil(np.abs(v)) for v in (own.min(axis=(0, 1)), own.max(axis=(0, 1))))
        xs, ys = (low[c] + spacing * np.arange(int((high[c] - low[c]) // spacing) + 1) for c in (0, 1))
        for x in xs:
            for y in ys:
                for t in own:
                    s = [(q[0] - o[0]) * (y - o[1]) - (q[1] - o[1]) * (x - o[0]) for o, q in zip(t, np.roll(t, -1, axis=0), strict=True)]
                    if min(s) > 0 or max(s) < 0:
                        want.add((key, float(x), float(y)))
    found = [tuple(r) for r in boxes.grid_points(triangles, spacing).collect()]
    assert set(found) == want and len(found) == len(want)
