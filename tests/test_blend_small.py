"""Small systems solved in a row against the same ones solved as tables."""

from __future__ import annotations

import numpy as np
from cinefold.operators import poisson


def test_rows_and_tables_give_the_same(spark, monkeypatch):
    """Keys of unlike sizes with holes, and far apart pixels; the small ones aren't given to the tables."""
    rng = np.random.default_rng(5)
    rows = []
    for key, (h, w) in enumerate([(1, 2), (4, 6), (7, 7), (3, 3)]):
        rows += [(key, y * (10**12 if key == 3 else 1), x, *rng.random(2).tolist(), bool(rng.random() < 0.7)) for y in range(h) for x in range(w) if rng.random() < 0.9]
    pixels = spark.createDataFrame(rows, "key long, y long, x long, source double, target double, inside boolean")
    wanted = {tuple(r)[:3]: r["value"] for r in poisson.blend(pixels, 0.0, 1.0, small=0).collect()}
    seen, tables = [], poisson.conjugate_gradients
    monkeypatch.setattr(poisson, "conjugate_gradients", lambda *a: seen.append(1) or tables(*a))
    for small in (30, poisson.SMALL):
        found = {tuple(r)[:3]: r["value"] for r in poisson.blend(pixels, 0.0, 1.0, small=small).collect()}
        assert found.keys() == wanted.keys() and all(abs(found[k] - v) < 1e-7 for k, v in wanted.items())
        assert len(seen) == 1  # the key of 49 pixels alone
