"""Counts of shared members: rows go to their members' slices once, and members of many sets in parts."""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from cinefold.operators import distance


def _members(spark, sets=300):
    """Every set has two members of its own neighbourhood; member -1 is in each third set."""
    rows = [(s, m) for s in range(sets) for m in ((s // 2), (s * 7) % 50 + 1000)] + [(s, -1) for s in range(0, sets, 3)]
    return spark.createDataFrame(rows, "set long, member long"), rows


def _plain(rows):
    held, both = {}, Counter()
    for s, m in rows:
        held.setdefault(m, set()).add(s)
    for sets in held.values():
        both.update(combinations(sorted(sets), 2))
    return dict(both)


def test_rows_are_sent_once(spark):
    members, rows = _members(spark)
    assert distance._dealt(members, 2048, 64).count() == len(rows)  # whatever the number of sets
    parts = -(-100 // 30)
    assert distance._dealt(members, 30, 64).count() == len(rows) + 100 * (parts - 1)


@pytest.mark.parametrize(("block", "pairs"), [(2048, 1 << 21), (30, 1 << 21), (2048, 64), (30, 64)])
def test_counts(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(distance, "_PAIRS", pairs)
    members, rows = _members(spark)
    found = distance.shared_counts(members, block, 64).collect()
    assert {(r["a"], r["b"]): r["both"] for r in found} == _plain(rows) and len(found) == len(_plain(rows))


@pytest.mark.parametrize("sent", [0, 1 << 19])
def test_overlap_with_and_without_broadcast(spark, monkeypatch, sent):
    monkeypatch.setattr(distance, "SENT", sent)
    members, rows = _members(spark, 40)
    values = spark.createDataFrame([(s, float(s)) for s in range(40)], "set long, value double")
    size = Counter(s for s, _ in set(rows))
    want = {p: abs(p[0] - p[1]) / (2 * n / (size[p[0]] + size[p[1]] + 0.01) + 0.01) for p, n in _plain(rows).items()}
    got = {(r["a"], r["b"]): r["distance"] for r in distance.overlap_normalised(members, values).collect()}
    assert got.keys() == want.keys() and np.allclose([got[p] for p in want], list(want.values()))
