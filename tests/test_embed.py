"""Embeddings against dense versions."""

from __future__ import annotations

import numpy as np
from cinefold.operators import distance, embed


def full_gradient(y: np.ndarray, p: np.ndarray) -> np.ndarray:
    gaps = y[:, None] - y[None]
    q = 1 / (1 + (gaps**2).sum(axis=2))
    np.fill_diagonal(q, 0)
    return np.einsum("ij,ijk->ik", (p - q / q.sum()) * q, gaps)


def planted(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Points in clumps, some at the very same place, and sparse symmetric affinities."""
    rng = np.random.default_rng(seed)
    y = rng.normal(size=(n, 2)) * 0.05 + rng.integers(0, 4, (n, 1)) * 10
    y[: n // 4] = y[0]
    p = np.triu(rng.random((n, n)) * (rng.random((n, n)) < 0.2), 1)
    return y, (p + p.T) / (2 * p.sum())


def frames(spark, y, p):
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "i long, x double, y double")
    return points, spark.createDataFrame([(int(i), int(j), float(p[i, j])) for i, j in zip(*np.nonzero(p), strict=True)], "i long, j long, value double")


def rows(found) -> np.ndarray:
    return np.array([r[1:] for r in sorted(found.collect())])


def test_gradient_without_angle_is_the_full_one(spark):
    y, p = planted(90, 1)
    points, pairs = frames(spark, y, p)
    assert np.allclose(rows(embed.tsne_gradient(points, pairs, 0.0, leaf=4)), full_gradient(y, p), atol=1e-12)


def test_gradient_by_angle_is_near(spark):
    y, p = planted(120, 2)
    points, pairs = frames(spark, y, p)
    near, full = rows(embed.tsne_gradient(points, pairs, 0.3, leaf=4)), full_gradient(y, p)
    assert 0 < np.abs(near - full).max() < 0.01 * np.abs(full).max()


def test_tree_holds_every_point_once(spark):
    y, p = planted(60, 3)
    tree, members, _ = embed.quadtree(frames(spark, y, p)[0], 4)
    found = tree.collect()
    assert sum(r["n"] for r in found if not r["open"]) == 60 == sum(r["n"] for r in members.collect())
    assert all(r["n"] > 4 for r in found if r["open"])
    assert len({(r["x"], r["y"]) for r in members.collect()}) == members.count() == len(np.unique(y, axis=0))


def test_steps_keep_momentum_and_gains(spark):
    y, p = planted(20, 4)
    y = y + np.arange(20)[:, None] * 1e-3
    points, pairs = frames(spark, y, p)
    v, gain, now = np.zeros_like(y), np.ones_like(y), y.copy()
    for _ in range(3):
        g = full_gradient(now, 4 * p)
        gain = np.maximum(0.01, np.where((g > 0) != (v > 0), gain + 0.2, gain * 0.8))
        v = 0.5 * v - 10 * gain * g
        now = now + v - (now + v).mean(axis=0)
    assert np.allclose(rows(embed.tsne(points, pairs, 3, angle=0.0, rate=10.0, leaf=64)), now, atol=1e-9)


def test_empty_and_single_points(spark):
    points = spark.createDataFrame([(7, 1.0, 2.0)], "i long, x double, y double")
    pairs = spark.createDataFrame([], "i long, j long, value double")
    assert embed.tsne_gradient(points, pairs).collect() == [(7, 0.0, 0.0)]
    assert embed.tsne(points.where("false"), pairs, 2).count() == 0


def test_stress_falls_to_the_planted_distances(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(size=(12, 2))
    pairs = [(i, j, float(np.linalg.norm(y[i] - y[j])), float(rng.random() + 0.5)) for i in range(12) for j in range(i)]
    start = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y + rng.normal(size=(12, 2)) * 0.1)] + [(99, 5.0, 5.0)], "i long, x double, y double")
    record, points = embed.stress_rounds(start, spark.createDataFrame(pairs, "i long, j long, target double, weight double"), 8)
    assert all(b <= a + 1e-12 for a, b in zip(record, record[1:], strict=False)) and record[-1] < record[0] / 10
    assert points.where("i = 99").collect() == [(99, 5.0, 5.0)]


def test_exact_repulsion_needs_no_tree_and_has_tasks_of_its_own(spark, monkeypatch):
    y, _ = planted(300, 6)
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "i long, x double, y double")
    monkeypatch.setattr(embed, "quadtree", None)
    tasks = []
    packed = distance._folded
    monkeypatch.setattr(distance, "_folded", lambda sides, fold, schema, count: tasks.append(count) or packed(sides, fold, schema, count))
    found = embed.repulsion(points, 0.0).collect()
    assert tasks[0] > 1 and sum(r["n"] for r in found) == 300
    gaps = y[:, None] - y[None]
    q = 1 / (1 + (gaps**2).sum(axis=2))
    at = {tuple(v): k for k, v in enumerate(y)}
    for r in found:
        k = at[r["x"], r["y"]]
        assert np.allclose([r["z"], r["fx"], r["fy"]], [q[k].sum() - 1, *(q[k][:, None] ** 2 * gaps[k]).sum(axis=0)], atol=1e-9)


def test_deep_levels_are_made_of_open_cells_alone(spark, monkeypatch):
    rng = np.random.default_rng(7)
    y = np.concatenate((rng.random((200, 2)), 0.5 + 1e-5 * rng.random((60, 2))))
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(y)], "i long, x double, y double")
    made, levels = [], embed._at_levels

    def counted(places, first, last):
        made.append(places.count() * (last - first + 1))
        return levels(places, first, last)

    monkeypatch.setattr(embed, "_at_levels", counted)
    tree, members, _ = embed.quadtree(points, 8)
    assert sum(made) < 260 * 16
    assert sum(r["n"] for r in tree.where("not open").collect()) == 260 == members.count()
