"""Least seams against minimum cuts, in one block of rows and in many."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.operators import graphcut, seam
from pyspark.sql import functions as F


@pytest.mark.parametrize("block", [3, 256])
def test_seams_cost_what_minimum_cuts_do(spark, block):
    """Blocks of three rows: with many zeros a seam winds and goes up again, over the borders too."""
    rng = np.random.default_rng(7)
    width, rows = 6, []
    for key, n in enumerate((1, 2, 3, 4, 60)):
        gaps = rng.random((n, width)) * (rng.random((n, width)) < 0.5) * 3
        rows += [(key, y, gaps[y].tolist()) for y in range(n)]
    rows = spark.createDataFrame(rows, "key long, y long, gaps array<double>")
    cells = rows.select("key", "y", F.posexplode("gaps").alias("x", "gap"))
    sure = F.when(F.col("x") == 0, 0).when(F.col("x") == width - 1, 1)
    costs = graphcut.seam_costs(cells.select("key", "y", "x", F.array(F.sqrt("gap")).alias("a"), F.array(F.lit(0.0)).alias("b"), sure.alias("sure")), 0.5)
    wanted = {r["key"]: r["flow"] for r in graphcut.min_cut(costs)[1].collect()}
    found = {r["key"]: r["cost"] for r in seam.least_seams(rows, width, block).collect()}
    assert found.keys() == wanted.keys() and all(abs(found[k] - wanted[k]) < 1e-4 for k in wanted)


def test_seams_go_up_again_over_a_border():
    """The one way that costs nothing goes down, up and down again; two blocks find it together."""
    down = np.full((6, 4), 50)
    aside = np.full((6, 3), 70)
    down[:4, 0] = 0
    aside[3, 0] = 0
    down[2:4, 1] = 0
    aside[1, 1] = 0
    down[2:, 2] = 0
    whole = seam._ends(down, aside)
    parts = seam._joined(seam._ends(down[:3], aside[:3]), seam._ends(down[3:], aside[3:]))
    assert whole[1].min() == 0 and all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))


def test_no_rows(spark):
    assert seam.least_seams(spark.createDataFrame([], "key long, y long, gaps array<double>"), 4).count() == 0
