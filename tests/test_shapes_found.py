"""Eigenvectors, clusters, peeled lines and blobs against dense and plain versions."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from cinefold.operators import blobs, lines, spectral


def test_eigenvectors_and_clusters(spark):
    rng = np.random.default_rng(8)
    centres = np.array([[0, 0], [3, 0], [0, 3]])
    x = np.concatenate([c + rng.normal(0, 0.3, (12, 2)) for c in centres])
    a = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1))
    np.fill_diagonal(a, 0)
    n = len(a)
    rows = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(n) for j in range(n) if i != j], "i long, j long, value double")
    d = a.sum(1)
    m = a / np.sqrt(np.outer(d, d))
    values, vectors = spectral.leading(spectral.normalised(rows), 3)
    true = np.linalg.eigvalsh(m)[::-1][:3]
    assert np.allclose(values, true, atol=1e-9)
    v = np.array([r["vector"] for r in sorted(vectors.collect())])
    assert np.allclose(m @ v, v * values, atol=1e-7) and np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    found = {r["i"]: r["cluster"] for r in spectral.clusters(rows, 3).collect()}
    assert len({tuple(sorted({found[i] for i in range(k, k + 12)})) for k in (0, 12, 24)}) == 3
    assert spectral.leading(rows.where("false"), 2)[0] == []


def test_k_means_equals_plain_rounds(spark):
    rng = np.random.default_rng(9)
    x = rng.random((40, 3))
    found = spectral.k_means(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i long, vector array<double>"), 4)
    centres = [x[(x**2).sum(1).argmax()]]
    while len(centres) < 4:
        centres.append(x[np.min([((x - c) ** 2).sum(1) for c in centres], axis=0).argmax()])
    old = None
    while True:
        now = np.argmin([((x - c) ** 2).sum(1) for c in centres], axis=0)
        if old is not None and (now == old).all():
            break
        old, centres = now, [x[now == c].mean(0) for c in range(4)]
    assert [r["cluster"] for r in sorted(found.collect())] == now.tolist()


def test_planted_lines_are_peeled(spark):
    rng = random.Random(5)
    rows, truth = [], [(2.0, 1.0), (-1.0, 0.5), (0.0, 4.0)]
    for key in (1, 2):
        for n, (slope, shift) in zip((60, 40, 25), truth, strict=True):
            for _ in range(n):
                x = rng.uniform(-3, 3)
                rows.append((key, len(rows), x, slope * x + shift + rng.uniform(-0.01, 0.01)))
        rows += [(key, len(rows) + i, rng.uniform(-3, 3), rng.uniform(-40, 40)) for i in range(10)]
    rows += [(3, -1, 1.0, 2.0), (4, -2, None, 1.0), (5, -3, 1.0, 1.0), (5, -4, 1.0, 2.0)]
    found, left = lines.peel(spark.createDataFrame(rows, "key long, id long, x double, y double"), 3, 150, 0.03)
    by = {(r["key"], r["line"]): r for r in found.collect()}
    for key in (1, 2):
        for line, (n, (slope, shift)) in enumerate(zip((60, 40, 25), truth, strict=True)):
            r = by[key, line]
            assert abs(r["slope"] - slope) < 0.02 and abs(r["intercept"] - shift) < 0.02 and n - 5 <= r["inliers"] <= n + 8
    assert len(by) == 6 and left.count() == len(rows) - 1


@pytest.mark.parametrize("tile", [(8, 64, 64), (2, 3, 2)])
def test_blobs_equal_flooding(spark, tile):
    rng = random.Random(6)
    rows = [(key, z, y, x, rng.choice([0, 0, 0, 0, 1, 2, None])) for key, depth in ((0, 1), (1, 5)) for z in range(depth) for y in range(7) for x in range(8)]
    cells = {r[:4]: r[4] for r in rows if r[4]}
    blob = {}
    for c in sorted(cells):
        if c in blob:
            continue
        blob[c], wave = c[1:], [c]
        while wave:
            k, *p = wave.pop()
            for d in itertools.product((-1, 0, 1), repeat=3):
                o = (k, *(a + b for a, b in zip(p, d, strict=True)))
                if cells.get(o) == cells[c] and o not in blob:
                    blob[o] = c[1:]
                    wave.append(o)
    sizes = {}
    for c, b in blob.items():
        sizes[c[0], cells[c], b] = sizes.get((c[0], cells[c], b), 0) + 1
    for least in (1, 4):
        found = blobs.labelled(spark.createDataFrame(rows, "key long, z long, y long, x long, value int"), least, tile).collect()
        want = {(*c, cells[c], b, sizes[c[0], cells[c], b]) for c, b in blob.items() if sizes[c[0], cells[c], b] >= least}
        assert {(r["key"], r["z"], r["y"], r["x"], r["value"], tuple(r["blob"]), r["size"]) for r in found} == want and len(found) == len(want)
