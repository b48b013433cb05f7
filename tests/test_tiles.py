"""Pairs that are only summed up meet in tiles that stay in a core's cache."""

from __future__ import annotations

import numpy as np
from cinefold.operators import distance


def _side(ids, pixels):
    return distance.Side(ids, np.ravel(pixels), [], [np.shape(pixels)[1]])


def test_no_tile_is_wider_than_its_bound(spark):
    rows = spark.range(3000).selectExpr("id AS frame", "array(cast(id AS double)) AS pixels")

    def weigh(x, y):
        assert len(y.ids) <= 2048
        return distance.lengths(x, y)

    got = {r["frame"]: r["sums"][0] for r in distance.summed(rows.where("frame < 3"), rows, weigh, 0).collect()}
    assert got == {k: float(np.abs(np.arange(3000) - k).sum()) for k in range(3)}


def test_without_reaches_near_frames():
    x, y = _side([1, 5], [[0.0], [0.0]]), _side([0, 1, 3, 5, 6], [[0.0]] * 5)
    assert distance.without(x, y, np.ones((2, 5)), 0.0).tolist() == [[1, 0, 1, 1, 1], [1, 1, 1, 0, 1]]
    assert distance.without(x, y, np.ones((2, 5)), 0.0, 2).tolist() == [[0, 0, 0, 1, 1], [1, 1, 0, 0, 0]]


def test_gaps_keep_digits_beside_one_far_row():
    x = np.random.default_rng(1).normal(size=(40, 5))
    y = np.concatenate((x + 1e-7, np.full((1, 5), 1e6), np.full((1, 5), np.nan), np.full((1, 5), 1e200)))
    for part in (y[:40], y[:41], y):
        with np.errstate(all="ignore"):
            assert np.allclose(distance.gaps(x, part), ((x[:, None] - part[None]) ** 2).sum(axis=2), rtol=1e-9, atol=0, equal_nan=True)
