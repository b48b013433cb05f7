"""Blends and solutions against dense linear algebra."""

from __future__ import annotations

import numpy as np
from cinefold.operators import poisson


def test_blends_equal_dense_solutions(spark):
    """Grids with holes, masks of any shape, masks at the edge, and a key without any."""
    rng = np.random.default_rng(3)
    rows, wanted = [], {}
    for key, (h, w) in enumerate([(1, 1), (3, 4), (5, 5), (4, 2)]):
        there = rng.random((h, w)) < 0.95
        source, target, inside = rng.random((h, w)), rng.random((h, w)), rng.random((h, w)) < (0.6 if key != 3 else 0.0)
        cells = [(y, x) for y in range(h) for x in range(w) if there[y, x]]
        rows += [(key, y, x, float(source[y, x]), float(target[y, x]), bool(inside[y, x])) for y, x in cells]
        free = [c for c in cells if inside[c]]
        matrix, right = np.zeros((len(free), len(free))), np.zeros(len(free))
        for n, (y, x) in enumerate(free):
            matrix[n, n], right[n] = 4, 4 * source[y, x]
            for other in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if other in cells:
                    right[n] -= source[other]
                    if inside[other]:
                        matrix[n, free.index(other)] = -1
                    else:
                        right[n] += target[other]
        solved = dict(zip(free, np.linalg.solve(matrix, right), strict=True)) if free else {}
        wanted |= {(key, *c): min(0.9, max(0.1, solved.get(c, target[c]))) for c in cells}
    pixels = spark.createDataFrame(rows, "key long, y long, x long, source double, target double, inside boolean")
    found = {(r["key"], r["y"], r["x"]): r["value"] for r in poisson.blend(pixels, 0.1, 0.9).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[c] - v) < 1e-7 for c, v in wanted.items())
    assert poisson.blend(pixels.where("false")).count() == 0
