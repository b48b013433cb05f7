"""Trees on odd rows; their splits are held against SQL by the queries."""

from __future__ import annotations

from cinefold.operators import forest

KIND = "key long, id long, features array<double>, positive boolean"


def test_nulls_repeats_and_pure_keys(spark):
    rows = [(1, k, [float(k), 0.0], k >= 6) for k in range(12)] + [(1, 90, [None, 0.0], True), (1, 91, [3.0, 0.0], None), (1, 92, [3.0], True), (1, 93, None, True)]
    rows += [(2, k, [float(k), 1.0], True) for k in range(5)] + [(3, k, [7.0, 7.0], k % 2 == 0) for k in range(4)]
    frame = spark.createDataFrame(rows, KIND)
    nodes = forest.grow(frame, 2, 2, 4)
    found = nodes.collect()
    roots = {(r["key"], r["tree"]): r for r in found if r["node"] == 1}
    assert roots[1, 0]["n"] == 12 and roots[1, 0]["feature"] == 0 and roots[2, 1]["feature"] is None and roots[3, 0]["feature"] is None
    at = {(r["key"], r["tree"], r["node"]): r for r in found}
    for (key, tree, node), r in at.items():  # children hold what their parent held
        if r["feature"] is not None:
            assert sum(at[key, tree, c]["n"] for c in (2 * node, 2 * node + 1) if (key, tree, c) in at) == r["n"]
    shares = {(r["key"], r["id"]): r["probability"] for r in forest.probabilities(frame.where("id < 90"), nodes, 4).collect()}
    assert len(shares) == 21 and shares[1, 0] < 0.5 < shares[1, 11] and shares[2, 3] == 1.0 and shares[3, 0] == 0.5


def test_empty_table(spark):
    none = spark.createDataFrame([], KIND)
    nodes = forest.grow(none, 2, 2, 3)
    assert nodes.count() == 0 and forest.probabilities(none, nodes, 3).count() == 0
