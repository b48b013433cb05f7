"""Blocks of frames, one row each, against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.operators import distance


def _frames(spark, x, kind="double"):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], f"frame long, pixels array<{kind}>")


def _gaps(x):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    return np.where(np.eye(len(x), dtype=bool), np.inf, d)


@pytest.mark.parametrize("scale, shift", [(1.0, 0.0), (1e-3, 1e6), (1e200, 0.0), (1e-30, 0.0), (0.0, 3.0)])
def test_nearest_is_exact_at_any_scale(spark, scale, shift):
    x = np.random.default_rng(3).normal(size=(90, 5)).round(1) * scale + shift
    x[40:60] = x[7]
    d = _gaps(x)
    want = {(i, r + 1): (int(j), d[i, j]) for i in range(90) for r, j in enumerate(np.lexsort((np.arange(90), d[i]))[:3])}
    rows = _frames(spark, x)
    got = {(r["frame"], r["rank"]): (r["neighbour"], r["d2"]) for r in distance.nearest(rows, rows, 3, skip_self=True, block=32).collect()}
    want = {k: v for k, v in want.items() if np.isfinite(v[1])}
    assert got == want


def test_last_near_is_the_last_within_the_threshold(spark):
    x = np.random.default_rng(4).normal(size=(80, 3)).round(1)
    near = np.sqrt(_gaps(x)) < 1.5
    rows = _frames(spark, x)
    got = {r["frame"]: r["pick"] for r in distance.last_near(rows, rows, 1.5, block=32).collect()}
    assert got == {i: int(np.flatnonzero(near[i]).max(initial=-1)) for i in range(80)}


def test_jumps_are_those_within_reach(spark):
    x = np.random.default_rng(5).normal(size=(60, 2)).round(1)
    found = {(r["i"], r["j"]) for r in distance.jumps(_frames(spark, x), 3, 20, 60, block=8).collect()}
    assert found == {(i, j) for i in range(60) for j in range(60) if 3 < abs(i - j) <= 20}


def test_a_block_is_one_row_of_what_is_shuffled(spark):
    rows = _frames(spark, np.zeros((2000, 4)), "float")
    seen = []

    def fold(x, y):
        import pandas as pd

        assert (np.diff(x.ids) > 0).all() and x.pixels.dtype == float
        yield pd.DataFrame({"n": [len(x.ids)], "m": [len(y.ids)]})

    seen = distance.units(rows, rows, fold, "n long, m long").collect()
    assert len(seen) == 64 and sum(r["n"] * r["m"] for r in seen) == 2000**2


def test_rows_of_different_lengths_are_an_error(spark):
    rows = spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0, 3.0])], "frame long, pixels array<double>")
    with pytest.raises(Exception, match="components"):
        distance.squared(rows, rows).count()


def test_nearest_looks_at_few_pairs_and_fewer_once_some_are_known():
    rng = np.random.default_rng(11)
    x, y = rng.normal(size=(100, 8)), rng.normal(size=(3000, 8))
    sides = [distance.Side(np.arange(len(v)) + at, v.ravel(), [], [8]) for v, at in ((x, 0), (y, 1000))]
    d = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    looked = {}
    for name, known in (("open", np.full(100, np.inf)), ("known", np.sort(d, axis=1)[:, 1])):
        pairs = [np.concatenate(p) for p in zip(*distance._candidates(*sides, 3, False, known), strict=True)]
        looked[name] = set(zip(*map(np.ndarray.tolist, pairs), strict=True))
    assert all((r, c) in looked["open"] for r in range(100) for c in np.argsort(d[r])[:3])
    assert all((r, c) in looked["known"] for r in range(100) for c in np.argsort(d[r])[:2])
    assert len(looked["known"]) < len(looked["open"]) < 100 * 12
