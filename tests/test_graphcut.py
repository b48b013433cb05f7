"""Cuts of small grids against every labelling, in one tile and in many."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from cinefold.operators import graphcut


def grids(seed, n, most=4):
    rng = random.Random(seed)
    for key in range(n):
        h, w = rng.randrange(1, most + 1), rng.randrange(1, most + 1)
        cells = [(y, x) for y in range(h) for x in range(w) if rng.random() < 0.95]
        cost = lambda: rng.choice([0.0, 0.5, 1.0, 2.25, round(rng.random() * 3, 3)])
        for y, x in cells:
            hard = rng.random()
            yield key, y, x, graphcut.FORBIDDEN if hard < 0.1 else cost(), graphcut.FORBIDDEN if hard > 0.9 else cost(), cost(), cost()


def paid(cells, labels):
    out = 0.0
    for (y, x), (c0, c1, right, down) in cells.items():
        out += c1 if labels[y, x] else c0
        out += right if labels.get((y, x + 1), labels[y, x]) != labels[y, x] else 0
        out += down if labels.get((y + 1, x), labels[y, x]) != labels[y, x] else 0
    return out


def best(cells):
    """The least cost, and the labelling with the most pixels at 0 among those that have it."""
    found = [(round(paid(cells, dict(zip(cells, way, strict=True))), 6), sum(way), way) for way in itertools.product((0, 1), repeat=len(cells))]
    least = min(found)[0]
    same = [np.array(f[2]) for f in found if f[0] == least]
    return least, np.minimum.reduce(same)  # cuts of least cost meet in one


@pytest.mark.parametrize("tile", [(64, 64), (2, 1)])
def test_cuts_equal_every_labelling(spark, tile):
    rows = [r for r in grids(1, 30, 3)] + [(100 + k, *r) for k, *r in grids(2, 2, 4)]
    pixels = spark.createDataFrame(rows, "key long, y long, x long, cost0 double, cost1 double, right double, down double")
    labels, flow = graphcut.min_cut(pixels, tile)
    costs = {r["key"]: r["cost"] for r in graphcut.cut_cost(pixels, labels).collect()}
    flows = {r["key"]: r["flow"] for r in flow.collect()}
    found = {(r["key"], r["y"], r["x"]): r["label"] for r in labels.collect()}
    for key in {r[0] for r in rows}:
        cells = {(y, x): rest for k, y, x, *rest in rows if k == key}
        least, way = best(cells)
        assert abs(flows[key] - least) < 1e-6 and abs(costs[key] - least) < 1e-6
        if least < graphcut.FORBIDDEN:
            assert [found[(key, y, x)] for y, x in cells] == way.tolist()


def test_tiles_of_a_large_grid_agree(spark):
    """A long seam: one tile and many give the same labels, and flow equals cut."""
    rng = np.random.default_rng(4)
    h, w = 40, 17
    a, b = rng.random((h, w)), rng.random((h, w))
    rows = [(1, y, x, [float(a[y, x])], [float(b[y, x])], 0 if x == 0 else 1 if x == w - 1 else None) for y in range(h) for x in range(w)]
    costs = graphcut.seam_costs(spark.createDataFrame(rows, "key long, y long, x long, a array<double>, b array<double>, sure int"), 0.5)
    found = []
    for tile in ((64, 64), (16, 9)):
        labels, flow = graphcut.min_cut(costs, tile)
        assert abs(flow.first()["flow"] - graphcut.cut_cost(costs, labels).first()["cost"]) < 1e-6
        found.append(sorted(map(tuple, labels.collect())))
    assert found[0] == found[1] and {r[3] for r in found[0]} == {0, 1}


def test_pairs_and_empty_grids(spark):
    pixels = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (1, 1, 0), (2, 5, 5)], "key long, y long, x long")
    assert sorted(tuple(r) for r in graphcut.grid_pairs(pixels).collect()) == [(1, 0, 0, "down"), (1, 0, 0, "right")]
    empty = spark.createDataFrame([], "key long, y long, x long, cost0 double, cost1 double, right double, down double")
    labels, flow = graphcut.min_cut(empty)
    assert labels.count() == 0 and flow.count() == 0
