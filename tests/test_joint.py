"""Joint paths against all paths, against chains, and in blocks against whole."""

from __future__ import annotations

import itertools

import numpy as np
from cinefold.operators import inference, joint

MOVES = [[0.0, 0.7, 1.5], [0.7, 0.0, 0.4], [1.5, 0.4, 0.0]]
CLASH = [[2.0, 0.5, 0.0], [0.5, 2.0, 0.0], [0.0, 0.0, 2.0]]
A, B = 0.5, 0.4


def made(seed, instances, keys, times):
    rng = np.random.default_rng(seed)
    return [{key: np.round(rng.random((t, 3)) * 2, 3) for key, t in zip(range(keys), itertools.cycle(times))} for _ in range(instances)]


def frames(spark, tables):
    return [spark.createDataFrame([(k, t, [float(x) for x in row]) for k, rows in table.items() for t, row in enumerate(rows)], "key long, t long, costs array<double>") for table in tables]


def cost(tables, key, paths):
    out = 0.0
    for table, path in zip(tables, paths, strict=True):
        out += A * sum(table[key][t][x] for t, x in enumerate(path)) + (1 - A) * (1 - B) * sum(MOVES[x][y] for x, y in zip(path, path[1:], strict=False))
    return out + (1 - A) * B * sum(CLASH[x][y] for one, two in itertools.combinations(paths, 2) for x, y in zip(one, two, strict=True))


def read(found):
    paths, known = {}, {}
    for r in sorted(found.collect(), key=lambda r: (r["key"], r["t"])):
        paths.setdefault(r["key"], []).append(r["labels"])
        known[r["key"]] = r["energy"], r["bound"]
    return {k: [list(x) for x in zip(*v, strict=True)] for k, v in paths.items()}, known


def test_two_instances_against_all_paths(spark):
    tables = made(1, 2, 5, [1, 3, 4, 5])
    paths, known = read(joint.joint(frames(spark, tables), MOVES, CLASH, A, B, 60))
    chains = inference.greedy(frames(spark, tables), MOVES, CLASH, A, B)
    by = [{(r["key"], r["t"]): r["label"] for r in c.collect()} for c in chains]
    for key, table in tables[0].items():
        ways = list(itertools.product(range(3), repeat=len(table)))
        least = min(cost(tables, key, pair) for pair in itertools.product(ways, ways))
        energy, bound = known[key]
        assert abs(energy - cost(tables, key, paths[key])) < 1e-9
        assert bound <= least + 1e-9 and least <= energy + 1e-9
        assert energy <= cost(tables, key, [[c[key, t] for t in range(len(table))] for c in by]) + 1e-9
        assert abs(energy - least) < 1e-6


def test_chains_alone_are_exact(spark):
    tables = made(2, 1, 4, [1, 7, 30])
    best = {r["key"]: r["energy"] for r in inference.viterbi(frames(spark, [{k: A * v for k, v in tables[0].items()}])[0], [[(1 - A) * (1 - B) * x for x in row] for row in MOVES]).collect()}
    for block in (2048, 8):
        _, known = read(joint.joint(frames(spark, tables), MOVES, CLASH, A, B, 1, block))
        for key, (energy, bound) in known.items():
            assert abs(energy - best[key]) < 1e-9 and abs(bound - best[key]) < 1e-9


def test_blocks_equal_whole(spark):
    """The rounds are the same ones, whether a task holds the key or blocks exchange its ends."""
    tables = made(3, 3, 3, [9, 14])
    rows = [r.cache() for r in frames(spark, tables)]
    (whole, one), (in_blocks, two) = (read(joint.joint(rows, MOVES, CLASH, A, B, 3, block)) for block in (2048, 6))
    assert whole == in_blocks
    for key, pair in one.items():
        assert np.allclose(pair, two[key], atol=1e-9) and pair[1] <= pair[0] + 1e-9
        assert abs(pair[0] - cost(tables, key, whole[key])) < 1e-9


def test_graphs_solved_together_equal_those_solved_alone(monkeypatch):
    """Chains of any lengths go through each time at once, so steps follow the times and not the graphs."""
    rng = np.random.default_rng(5)
    costs = [np.round(rng.random((2, t, 3)) * 2, 3) for t in (1, 9, 4, 9, 30, 2) * 20]
    start = [c.argmin(axis=2) for c in costs]
    alone = [joint.solved([c], [s], np.array(MOVES), np.array(CLASH), 30)[0] for c, s in zip(costs, start, strict=True)]
    calls, paths = [], joint._paths
    monkeypatch.setattr(joint, "_paths", lambda *given: calls.append(1) or paths(*given))
    both = joint.solved(costs, start, np.array(MOVES), np.array(CLASH), 30)
    assert len(calls) <= 30
    for (one, energy, bound), (two, same, low) in zip(alone, both, strict=True):
        assert one.shape == two.shape and abs(energy - same) < 1e-9 and abs(bound - low) < 1e-6
