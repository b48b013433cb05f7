"""Tails of paired sequences: one join and one pass over a key's rows."""

from __future__ import annotations

from cinefold.operators import synthesis


def test_tails_take_one_join(spark):
    rows = [("x", 0, 3, -1), ("x", 1, 4, 0), ("y", 0, -1, 2), ("y", 1, 2, -1), ("z", 5, 1, 1), ("long", 0, 9, 0)]
    pairs = spark.createDataFrame(rows, "key string, t int, a long, b long")
    lengths = spark.createDataFrame([(k, 6, 3) for k in ("x", "y", "z", "long", "none")], "key string, a_length int, b_length int")
    found = synthesis.tail_aligned(pairs, lengths)
    assert sorted(map(tuple, found.collect())) == [("x", 1, 4, 0), ("x", 2, 5, 1), ("z", 5, 1, 1), ("z", 6, 2, 2)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
