"""Tiles reach Python in bounded batches."""

from __future__ import annotations

from cinefold.operators import graphcut


def test_tiles_run_in_small_batches_and_the_bound_comes_back(spark, monkeypatch):
    name, seen, settled = "spark.sql.execution.arrow.maxBytesPerBatch", [], graphcut.settled
    before = spark.conf.get(name)
    monkeypatch.setattr(graphcut, "settled", lambda frame: seen.append(("state" in frame.columns, spark.conf.get(name))) or settled(frame))
    pixels = spark.createDataFrame([(1, 0, x, float(x), 1.0, 0.5, 0.0) for x in range(3)], "key long, y long, x long, cost0 double, cost1 double, right double, down double")
    tiles = graphcut._step(graphcut._tiles(pixels, (2, 2)), None, graphcut.F.lit(1))
    assert tiles.count() == 2 and seen == [(True, f"{graphcut.BYTES}b")] * 2
    assert spark.conf.get(name) == before
