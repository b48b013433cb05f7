"""Micro cases by hand and by brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from cinefold.operators import aggregate, cost, distance, graph, inference, models, sequence, sparse, tracks
from cinefold.sources import readers, sinks
from cinefold.streaming import playback
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def _frames(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(rows)], "frame long, pixels array<double>")


def test_distances_are_symmetric_with_a_zero_diagonal(spark):
    rows = _frames(spark, np.random.default_rng(0).normal(size=(7, 3)))
    found = {(r["i"], r["j"]): r["d2"] for r in distance.squared(rows, rows, block=3).collect()}
    assert len(found) == 49 and all(found[i, i] == 0 and found[i, j] == found[j, i] for i, j in found)


def test_nearest_breaks_ties_by_number_and_exact_hits_give_their_value(spark):
    rows = _frames(spark, [(0, 0), (1, 0), (-1, 0), (0, 0)])
    near = distance.nearest(rows, rows, 2, skip_self=True, block=2)
    found = {(r["frame"], r["rank"]): r["neighbour"] for r in near.collect()}
    assert found[0, 1] == 3 and found[0, 2] == 1 and found[1, 1] == 0
    values = spark.createDataFrame([(i, float(i)) for i in range(4)], "frame long, value double")
    assert {r["frame"]: r["value"] for r in distance.inverse_distance(near, values).collect()}[0] == 3.0


def test_empty_tables(spark):
    rows = _frames(spark, [])
    assert distance.squared(rows, rows).count() == 0 and distance.nearest(rows, rows, 2).count() == 0


@pytest.mark.parametrize("block", [1, 2, 100])
def test_viterbi_equals_brute_force(spark, block):
    random = np.random.default_rng(block)
    moves = random.integers(0, 9, (3, 3)).astype(float)
    moves[0, 2] = math.inf
    costs = {key: random.integers(0, 9, (n, 3)).astype(float) for key, n in (("a", 5), ("b", 1), ("c", 6))}
    rows = spark.createDataFrame([(k, t, c.tolist()) for k, v in costs.items() for t, c in enumerate(v)], "key string, t int, costs array<double>")
    found = inference.viterbi(rows, moves.tolist(), block=block).collect()
    for key, table in costs.items():
        price = lambda p: sum(table[t][s] for t, s in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        best = min(price(p) for p in itertools.product(range(3), repeat=len(table)))
        own = sorted((r["t"], r["label"], r["energy"]) for r in found if r["key"] == key)
        assert price([x[1] for x in own]) == best == own[0][2]


def test_smoothing_a_short_series_renormalises_at_the_edges(spark):
    rows = spark.createDataFrame([("a", t, v) for t, v in enumerate([1.0, 2.0, 4.0])], "key string, t int, value double")
    found = {r["t"]: r["value"] for r in sequence.binomial_smooth(rows, 2).collect()}
    w = [math.comb(4, k) / 16 for k in range(5)]
    raised = [x ** math.exp(2 / 0.4) for x in w]
    assert found[1] == pytest.approx(sum(a * b for a, b in zip([x ** math.exp(2 / 0.4) for x in w[1:4]], [1, 2, 4])) / sum(raised[1:4]))
    assert {r["t"]: r["value"] for r in sequence.box_smooth(rows, 5).collect()}[0] == pytest.approx((1 + 1 + 1 + 2 + 4) / 5)


def test_order_statistic_is_not_interpolated(spark):
    rows = spark.createDataFrame([(float(v),) for v in range(16)], "v double")
    assert cost.order_statistic(rows, "v", 0.1) == 1.0
    many = spark.range(50_000).select((F.col("id") % 977).cast("double").alias("v"))
    assert cost.order_statistic(many, "v", 0.37) == sorted(i % 977 for i in range(50_000))[int(50_000 * 0.37)]


def _sparse(spark, cells, default):
    return sparse.Sparse(spark.createDataFrame([(list(k), float(v)) for k, v in cells.items()], "idx array<int>, value double"), (3, 3), default)


@settings(max_examples=5, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 2), st.integers(0, 2)), st.integers(-5, 5), min_size=1, max_size=4), st.dictionaries(st.tuples(st.integers(0, 2), st.integers(0, 2)), st.integers(1, 5), min_size=1, max_size=4))
def test_sparse_equals_dense(spark, a, b):
    for name, operation in (("add", np.add), ("mod", np.mod), ("floordiv", np.floor_divide)):
        one, two = np.full((3, 3), -7.0), np.full((3, 3), 3.0)
        for k, v in a.items():
            one[k] = v
        for k, v in b.items():
            two[k] = v
        out = sparse.combine(_sparse(spark, a, -7.0), _sparse(spark, b, 3.0), name)
        dense = np.zeros((3, 3))
        for r in sparse.dense(out).collect():
            dense[tuple(r["idx"])] = r["value"]
        assert np.array_equal(dense, operation(one, two))


def test_sparse_guards(spark):
    one = _sparse(spark, {(1, 1): 10}, 0)
    with pytest.raises(ValueError):
        sparse.combine(one, one._replace(shape=(2, 2)), "add")
    with pytest.raises(ZeroDivisionError):
        sparse.combine(one, one, "div")
    assert sparse.total(_sparse(spark, {(1, 1): 10}, 3)).first()[0] == 3 * 9 + 7


def test_validator_tries_its_checks_in_order(spark):
    schema = "frames int, distance_rows int, transition_rows int, has_masks boolean, patches int, first_missing_box int, first_missing_patch int, semantic_rows int"
    rows = [(5, None, 5, False, None, None, None, 5), (5, 4, 5, False, None, None, None, 5), (5, 5, None, False, None, None, None, 5), (5, 5, 4, False, None, None, None, 5), (5, 5, 5, True, None, 0, 0, 5),
            (5, 5, 5, True, 5, 1, 1, 5), (5, 5, 5, True, 5, 3, 1, 5), (5, 5, 5, True, 5, 4, 4, None), (5, 5, 5, False, 5, None, None, 4), (5, 5, 5, True, 5, 4, 4, 5)]
    assert [r["code"] for r in aggregate.validate(spark.createDataFrame(rows, schema)).collect()] == [1, 11, 2, 21, 31, 3, 32, 4, 41, 0]


def test_readers(spark, tmp_path):
    (tmp_path / "det.txt").write_text("1,9,1,2,3,4,0.05\n1,9,1,2,3,4,0.5\n1,9,5,2,3,4,0.9\n2,9,1,2,3,4,0.1\n")
    found = sorted((r["frame"], r["object"], r["x"]) for r in readers.mot_tracks(spark, str(tmp_path / "det.txt")).collect())
    assert found == [(0, 1, 1.0), (0, 2, 5.0), (1, 1, 1.0)]
    (tmp_path / "a.txt").write_text("1 2 3\n4 5 3\n0 0 1\n")
    (tmp_path / "b.txt").write_text("1 2 3\noops\n")
    assert sorted((r["frame"], r["x"]) for r in readers.space_tracks(spark, str(tmp_path / "[ab].txt")).collect()) == [(1, 0.0), (3, 4.0)]
    (tmp_path / "m.obj").write_text("v 0 0 0\nv 1 0 0\nvt 0.5 0.5\nf 1/1 2/1 1/1\n")
    mesh = readers.obj_mesh(spark, str(tmp_path / "m.obj"))
    assert mesh["v"].count() == 2 and sorted((r["corner"], r["v"], r["vt"], r["vn"]) for r in mesh["f"].collect()) == [(1, 1, 1, None), (2, 2, 1, None), (3, 1, 1, None)]
    (tmp_path / "k.key").write_text("1 4\n1 2 3 4\n3 0 4 0\n")
    assert readers.descriptors(spark, str(tmp_path / "k.key"), 4).first()["pixels"] == [0.6, 0.0, 0.8, 0.0]
    (tmp_path / "s.log").write_text("GO-&-2020-01-02 03:04:05.000006\nBAD\n")
    assert [r["ts"] is None for r in readers.session_log(spark, str(tmp_path / "s.log")).orderBy("id").collect()] == [False, True]
    (tmp_path / "x.mat").write_text("1 2\n3,4\n")
    assert sorted(map(tuple, readers.text_matrix(spark, str(tmp_path / "x.mat")).select("i", "j", "value").collect())) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]


def test_sink_skips_what_is_there(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.append_missing(rows.where("k = 1"), ["k"], str(tmp_path / "t"))
    sinks.append_missing(rows, ["k"], str(tmp_path / "t"))
    assert sorted(r["k"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2]


def test_commands_keep_state_between_batches(spark, tmp_path):
    schema = "key string, ts timestamp, command int"
    spark.createDataFrame([("a", None, 1)], schema).withColumn("ts", F.timestamp_seconds(F.lit(1))).write.parquet(str(tmp_path / "in"))
    run = lambda: playback.commands(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), delay=2).writeStream.format("parquet").option(
        "checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    run()
    spark.createDataFrame([("a", None, 2)], schema).withColumn("ts", F.timestamp_seconds(F.lit(2))).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    found = sorted((r["ts"], r["step"], r["before"], r["after"], round(r["weight"], 4)) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [x[2:4] for x in found] == [(0, 1)] * 3 + [(1, 2)] * 3 and [x[4] for x in found[:3]] == [0.2099, 0.7901, 1.0]


def test_shapes():
    square, far = [(0, 0), (2, 0), (2, 2), (0, 2)], [(5, 5), (6, 5), (6, 6)]
    assert sorted(models.clip_polygon(square, [(1, 1), (3, 1), (3, 3), (1, 3)])) == [(1, 1), (1, 2), (2, 1), (2, 2)] and models.clip_polygon(square, far) is None
    assert len(models.ears([(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)])) == 3
    assert models.smallest_box(np.array([(0, 0), (1, 1), (0, 2), (-1, 1)]))[0] == pytest.approx(2)
    points = models.poisson_discs((0, 0), (10, 10), 2.0)
    assert min(math.dist(a, b) for a, b in itertools.combinations(points.tolist(), 2)) >= 2


def test_blob_relation_and_depth(spark):
    pair = lambda rows: spark.createDataFrame(rows, "pixel int, blob int")
    found = aggregate.blob_relation(pair([(1, 1), (2, 2), (3, 3), (4, 3), (5, 4)]), pair([(1, 9), (2, 9), (3, 7), (4, 8), (6, 6)]))
    assert sorted((r["old"] or 0, r["new"] or 0, r["kind"]) for r in found.collect()) == [(0, 6, "birth"), (1, 9, "merge"), (2, 9, "merge"), (3, 7, "split"), (3, 8, "split"), (4, 0, "death")]
    boxes = spark.createDataFrame([(0, 1, 0.0, 0.0, 2.0, 9.0), (0, 2, 1.0, 0.0, 2.0, 3.0)], "frame long, object long, x double, y double, w double, h double")
    assert [r["object"] for r in tracks.depth_order(boxes).orderBy("place").collect()] == [2, 1]


def test_parts_that_all_lines_connect_equal_brute_force(spark):
    import duckdb
    from cinefold.plans import catalog
    from compare import SMALL

    top = {}

    def root(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for part, supplier in duckdb.sql(f"SELECT 'p' || l_partkey, 's' || l_suppkey FROM '{SMALL}/lineitem.parquet'").fetchall():
        a, b = root(part), root(supplier)
        top[max(a, b)] = min(a, b)
    found = catalog.QUERIES["connected_parts_whole"](spark, SMALL).collect()
    assert len(found) == len(top) and {r["node"]: r["component"] for r in found} == {x: root(x) for x in top}


def test_components_of_hubs_and_chains_equal_brute_force(spark):
    edges = [(f"h{k % 3}", f"l{k}") for k in range(90)] + [(f"c{k:02}", f"c{k + 1:02}") for k in range(40)]
    for few in (0, 1 << 14):
        found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a string, b string"), few).collect()}
        assert found == {x: "c00" if x[0] == "c" else f"h{int(x[1:]) % 3}" for edge in edges for x in edge}


def test_geodesic_costs_of_many_jumps_equal_dijkstra(spark, tmp_path):
    import heapq

    from cinefold.plans import catalog

    n = 25
    at = np.cumsum(np.random.default_rng(4).uniform(0.3, 0.9, n)).astype(np.float32)
    rows = [(k, [float(x), 0.0], 0) for k, x in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    best, heap = {}, [(0.0, 0, 0)]
    while heap:
        cost_, i, jumps = heapq.heappop(heap)
        if i not in best:
            best[i] = (cost_, jumps)
            for j in range(n):
                if abs(i - j) >= 3:
                    heapq.heappush(heap, (cost_ + abs(float(at[i]) - float(at[j])) ** 4, j, jumps + 1))
    assert max(jumps for _, jumps in best.values()) > 3
    found = {r["at"]: r["value"] for r in catalog.QUERIES["geodesic_cost"](spark, str(tmp_path)).collect()}
    assert found.keys() == best.keys() and all(found[i] == pytest.approx(best[i][0], abs=1e-4) for i in best)
