"""Medians, diagonal sums, transition costs and range shares without a table of pairs, against those over the table."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.operators import cost, distance, sequence
from pyspark.sql import functions as F


def _frames(spark, n=45):
    x = np.random.default_rng(8).normal(size=(n, 3))
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "frame long, pixels array<double>"), x


def _matrix(rows):
    return distance.squared(rows, rows).select("i", "j", F.sqrt("d2").alias("value"))


def _cells(frame):
    return {(r["i"], r["j"]): float(f"{r['value']:.9g}") for r in frame.collect()}


@pytest.mark.parametrize("missing", [[], [0, 17, 18, 44]])
def test_diagonal_sums(spark, missing):
    rows, _ = _frames(spark)
    rows = rows.where(~F.col("frame").isin(*missing)) if missing else rows
    assert _cells(distance.diagonal_sums(rows, 2, 45, block=16)) == _cells(sequence.diagonal_filter(_matrix(rows), 2, 45))


def test_transitions(spark):
    rows, _ = _frames(spark)
    want = cost.transition_matrix(_matrix(rows), 45, 2, 0.3, 5, sigma=0.5)
    assert _cells(cost.transitions_between(rows, 2, 0.3, 5, sigma=0.5, block=16)) == _cells(want)


def test_range_shares(spark):
    rows, _ = _frames(spark)
    assert _cells(cost.range_probability_between(rows, 0.5)) == _cells(cost.range_probability(_matrix(rows), 0.5))


def test_median_narrows_in(spark, monkeypatch):
    monkeypatch.setattr(distance, "FEW", 20)
    monkeypatch.setattr(distance, "BUCKETS", 8)
    rows, x = _frames(spark)
    assert abs(distance.median_length(rows) - np.median(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)))) < 1e-12
