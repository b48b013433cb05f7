"""Links between near frames as stars, against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.operators import distance, edits
from cinefold.operators.graph import united


@pytest.mark.parametrize(("block", "links"), [(20, 7), (16384, 1 << 15)])
def test_links_are_stars_that_join_what_all_pairs_join(spark, monkeypatch, block, links):
    monkeypatch.setattr(distance, "_LINKS", links)
    rng = np.random.default_rng(3)
    places = np.round(rng.random((90, 3)) * 4) / 2  # on a lattice, so many pairs are just at the limit
    places[60:] = places[0]
    rows = spark.createDataFrame([(i * 3, p.tolist()) for i, p in enumerate(places)], "frame long, pixels array<double>")
    d = ((places[:, None] - places[None]) ** 2).sum(axis=2)
    top = united(90, [np.nonzero(d <= 0.25)])
    assert {r["frame"]: r["cluster"] for r in edits.single_link(rows, 0.25).collect()} == {i * 3: int(t) * 3 for i, t in enumerate(top)}
    units = (-(-90 // block)) ** 2
    assert distance.linked(rows, 0.25, block).count() <= 2 * 90 * max(units, distance.SPREAD**2) and 1 < len(set(top)) < 60
    assert {tuple(r) for r in distance.linked(rows.limit(1), 0.25).collect()} == set()
