"""Units of two blocks have tasks of their own, however few bytes they read, and blocks of any size are measured a few at a time."""

from __future__ import annotations

import numpy as np
from cinefold.operators import cost, distance
from pyspark.sql import functions as F


def test_thin_rows_are_not_put_into_one_task(spark):
    values = spark.range(1000).select(F.col("id").alias("frame"), (F.col("id") * 0.5).alias("value"))
    found = cost.outer(values, values)
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 16 and sum(r["count"] for r in parts) == 10**6 and max(r["count"] for r in parts) < 10**5


def test_gaps_by_parts(monkeypatch):
    x, y = np.random.default_rng(3).normal(size=(2, 40, 7))
    want = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    for size in (1, 100, 1 << 15):
        monkeypatch.setattr(distance, "_AGAIN", size)
        assert (distance._gaps(x, y[:33]) == want[:, :33]).all()
    assert distance._gaps(x, y[:0]).shape == (40, 0)
