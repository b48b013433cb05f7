"""Volumes fitted to tracks: slopes against differences, planted volumes recovered, short and long tracks alike."""

from __future__ import annotations

import numpy as np
import pytest
from cinefold.functions.geometry import look_at
from cinefold.operators import fits
from pyspark.sql import functions as F

CAMERA = look_at((2.5, -12.0, 9.0), (2.5, 3.0, 0.0), 900.0, (640.0, 360.0))


def planted(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A volume's parameters and n rows of a track with the boxes that it fills exactly."""
    rng = np.random.default_rng(seed)
    truth = np.array([1.6, 3.3, 1.4, 0.2, -0.3, 0.15, 1.05, 0.95]) + rng.normal(size=8) * 0.05
    seen = np.column_stack((rng.random(n) * 5, rng.random(n) * 5, rng.random(n), np.zeros((n, 4))))
    seen[:, 3:] = fits.box_residuals(np.tile(truth, (n, 1)), np.zeros(n), seen, CAMERA)[0]
    return truth, seen


def test_slopes_equal_differences():
    truth, seen = planted(40, 1)
    at, first = np.tile(truth * 1.03, (40, 1)), np.full(40, 0.1)
    slopes = fits.box_residuals(at, first, seen, CAMERA)[1]
    prior = fits.shape_residuals(at, 2.0)[1]
    for k in range(8):
        step = np.zeros(8)
        step[k] = 1e-6
        gap = lambda f: (f(at + step)[0] - f(at - step)[0]) / 2e-6  # noqa: B023, E731
        assert np.allclose(slopes[:, :, k], gap(lambda p: fits.box_residuals(p, first, seen, CAMERA)), atol=1e-3)
        assert np.allclose(prior[:, :, k], gap(lambda p: fits.shape_residuals(p, 2.0)), atol=1e-6)


def frames(spark, tracks, start):
    rows = [(k, *map(float, r)) for k, (_, seen) in enumerate(tracks) for r in seen]
    observed = spark.createDataFrame(rows, "key long, x double, y double, turn double, left double, top double, right double, bottom double")
    return observed, spark.createDataFrame([(k, start) for k in range(len(tracks))], "key long, start array<double>")


START = [1.7, 3.2, 1.3, 0.0, 0.0, 0.0, 1.0, 1.0]


@pytest.mark.parametrize("long", [4096, 16])
def test_planted_volumes_are_recovered(spark, long):
    tracks = [planted(n, n) for n in (12, 30, 70)]
    found = {r["key"]: r for r in fits.fitted(*frames(spark, tracks, START), CAMERA, long=long).collect()}
    assert len(found) == 3
    for k, (truth, _) in enumerate(tracks):
        assert np.allclose(found[k]["fit"], truth, atol=1e-5) and found[k]["cost"] < 1e-8


def test_held_parameters_stay_and_the_cost_is_least(spark):
    truth, seen = planted(30, 9)
    seen[:, 3:] += np.random.default_rng(1).normal(size=(30, 4))
    row = fits.fitted(*frames(spark, [(truth, seen)], START), CAMERA, held=("height", "stretch_x", "stretch_y"), prior=5.0).first()
    fit = np.array(row["fit"])
    assert list(fit[[2, 6, 7]]) == [1.3, 1.0, 1.0]
    cost = lambda p: sum((r**2).sum() for r in (fits.box_residuals(np.tile(p, (30, 1)), np.zeros(30), seen, CAMERA)[0], fits.shape_residuals(p[None], 5.0)[0]))
    assert abs(cost(fit) - row["cost"]) < 1e-6
    for k in (0, 1, 3, 4, 5):
        for way in (-1e-3, 1e-3):
            assert cost(fit + way * np.eye(8)[k]) > row["cost"]


def test_nulls_empty_tables_and_single_frames(spark):
    truth, seen = planted(20, 4)
    observed, start = frames(spark, [(truth, seen)], START)
    assert fits.fitted(observed.where("false"), start, CAMERA).count() == 0
    assert fits.fitted(observed, start.where("false"), CAMERA).count() == 0
    dirty = observed.unionByName(observed.limit(1).selectExpr("key", "x", "y", "turn", "cast(null as double) left", "top", "right", "bottom"))
    assert np.allclose(fits.fitted(dirty, start, CAMERA).first()["fit"], truth, atol=1e-5)
    one = fits.fitted(observed.limit(1), start, CAMERA, held=tuple(set(fits.PARAMETERS) - {"x", "y", "turn"})).first()
    assert np.isfinite(one["fit"]).all()


def test_single_frames_never_end_above_their_start(spark):
    truth, seen = planted(40, 6)
    start = [[*truth[:3], *(truth[3:6] + 0.1), 1.05, 0.95]] * 40
    rows = [(k, *map(float, r)) for k, r in enumerate(seen)]
    observed = spark.createDataFrame(rows, "key long, x double, y double, turn double, left double, top double, right double, bottom double")
    begun = spark.createDataFrame([(k, [float(x) for x in s]) for k, s in enumerate(start)], "key long, start array<double>")
    found = sorted(fits.fitted(observed, begun, CAMERA, held=("width", "length", "height", "stretch_x", "stretch_y")).collect())
    first = (fits.box_residuals(np.array(start), np.array(start)[:, 5], seen, CAMERA)[0] ** 2).sum(axis=1)
    assert len(found) == 40 and all(r["cost"] <= f for r, f in zip(found, first, strict=True))
    assert all(list(np.array(r["fit"])[[0, 1, 2, 6, 7]]) == [start[0][k] for k in (0, 1, 2, 6, 7)] for r in found)


def test_rows_refined_where_they_are_equal_keys_fitted(spark):
    truth, seen = planted(30, 6)
    start = [float(v) for v in [*truth[:3], *(truth[3:6] + 0.1), 1.05, 0.95]]
    rows = spark.createDataFrame([(k, start, *map(float, r)) for k, r in enumerate(seen)], "key long, start array<double>, x double, y double, turn double, left double, top double, right double, bottom double")
    held = ("width", "length", "height", "stretch_x", "stretch_y")
    dirty = rows.unionByName(rows.limit(1).withColumn("x", F.lit(None).cast("double")))
    found = fits.refined(dirty, CAMERA, ["key"], held=held)
    assert "Exchange" not in fits.refined(rows, CAMERA, ["key"], held=held)._jdf.queryExecution().executedPlan().toString()
    want = {r["key"]: r for r in fits.fitted(rows.drop("start"), rows.select("key", "start"), CAMERA, held=held).collect()}
    got = found.collect()
    assert len(got) == len(want) == 30
    for r in got:
        assert np.allclose(r["fit"], want[r["key"]]["fit"], atol=1e-7) and abs(r["cost"] - want[r["key"]]["cost"]) < 1e-6


def test_slopes_of_a_row_need_no_table_of_corners():
    """A row's slopes are those of the four corners that make its sides, not of all eight by all coordinates."""
    import tracemalloc

    truth, seen = planted(4000, 5)
    at = np.tile(truth, (4000, 1))
    tracemalloc.start()
    fits.box_residuals(at, np.zeros(4000), seen, CAMERA)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4000 * 8 * 256
