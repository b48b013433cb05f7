"""Queries over transition costs, chains and label propagation, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import cost, distance, inference, joint
from cinefold.plans.pairwise import PAIRS, SERIES, cross_ssd_by_label, frames, series

MOVES = [[abs(a - b) * 0.5 for b in range(5)] for a in range(5)]
EDGES = [(a, b, 0.25 * (a + b)) for a in range(5) for b in range(5) if abs(a - b) <= 1]
CLASH = [[2.0 if a == b else 0.0 for b in range(5)] for a in range(5)]


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.squared(rows, rows).select("i", "j", F.sqrt("d2").alias("value"))


def _round(frame: DataFrame, digits: int = 5) -> DataFrame:
    return frame.withColumn("value", F.round("value", digits))


def _chains(spark: SparkSession, sf_dir: str, shift: float = 0.0) -> DataFrame:
    """A chain a user over five levels: the cost of level l is how far value / 100 is from it."""
    level = lambda l: F.round(F.abs(F.col("value") / 100 + shift - l), 4)  # noqa: E731, E741
    return series(spark, sf_dir).select("key", "t", F.array(*[level(l) for l in range(5)]).alias("costs"))  # noqa: E741


def transition_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cost.transitions_between(frames(spark, sf_dir), 2, 0.1, 5, sigma=0.5), 4)


def range_prob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cost.range_probability_between(frames(spark, sf_dir), 0.5), 7)


def top_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(cost.top_transitions(distance.jumps(frames(spark, sf_dir), 100, 400, 10), 100, 400, 10, 50))


def frame_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cross_ssd_by_label(spark, sf_dir).select("frame", F.col("label").alias("class"), F.col("d2").alias("value"))
    return cost.softmax(found).withColumn("weight", F.round("weight", 5))


def semantic_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = frames(spark, sf_dir).select("frame", F.col("label").alias("class"), F.lit(0.75).alias("weight"))
    return _round(cost.class_likelihood(labels, 3, 0.5))


def unary_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select(F.col("t"), F.col("key").alias("label"), F.exp(-F.abs(F.col("value") / 100 - 2)).alias("value"))
    return cost.unary(rows).withColumn("cost", F.round("cost", 5))


def viterbi_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least cost of every user's chain."""
    return inference.viterbi(_chains(spark, sf_dir), MOVES).groupBy("key").agg(F.round(F.max("energy"), 5).alias("energy"), F.count("*").alias("n"))


def sparse_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.sparse_viterbi(_chains(spark, sf_dir), EDGES, 5).groupBy("key").agg(F.round(F.max("energy"), 5).alias("energy"), F.count("*").alias("n"))


def greedy_multi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances a user, the second avoiding the first's levels."""
    out = inference.greedy([_chains(spark, sf_dir), _chains(spark, sf_dir, 0.3)], MOVES, CLASH, 0.5, 0.5)
    return out[0].select("key", "t", F.col("label").alias("one")).join(out[1].select("key", "t", F.col("label").alias("two"), F.round("energy", 5).alias("energy")), ["key", "t"])


def joint_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two instances a user, chosen together: the least energy that their paths can have."""
    found = joint.joint([_chains(spark, sf_dir), _chains(spark, sf_dir, 0.3)], MOVES, CLASH, 0.5, 0.5)
    return found.groupBy("key").agg(F.count("*").alias("n"), F.round(F.max("energy"), 4).alias("energy"))


def future_cost_fixed_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(inference.future_cost_between(frames(spark, sf_dir), 2.0, 0.9, sweeps=3))


def geodesic_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(inference.shortest_between(frames(spark, sf_dir), lambda d: (d * d) ** 2, 0, 3))


def compat_labelprob(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = frame_softmax(spark, sf_dir)
    of = lambda c: weights.where(F.col("class") == c).select("frame", F.col("weight").alias("value"))
    return _round(cost.outer(of(0), of(1)), 8)


def compat_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    sigma = round(distance.median_length(rows), 6)
    row = lambda k: distance.squared(rows.where(F.col("frame") == k), rows).select("i", "j", F.sqrt("d2").alias("value"))
    return _round(cost.outer(cost.kernel(row(0), 0, sigma), cost.kernel(row(7), 7, sigma), 1.0))


def label_prop_k_iters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sweeps from every tenth frame's label."""
    rows = frames(spark, sf_dir)
    labelled = rows.where("frame % 10 = 0").select("frame", F.col("label").alias("class"))
    return _round(inference.propagate_between(rows, labelled, lambda d: np.exp(-d / 0.06), sweeps=3, tolerance=-1.0))


QUERIES = {
    f.__name__: f
    for f in (transition_cost, range_prob, top_transitions, frame_softmax, semantic_likelihood, unary_cost, viterbi_path, sparse_viterbi, greedy_multi, joint_synthesis, future_cost_fixed_k, geodesic_cost, compat_labelprob, compat_kernel, label_prop_k_iters)
}

_D = f"{PAIRS}, d AS (SELECT i, j, sqrt(d2) AS value FROM p), n AS (SELECT count(*) AS n FROM embeddings)"
_SOFT = """
    e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
    m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY label, k),
    c AS MATERIALIZED (SELECT e.vec_id AS frame, m.label::BIGINT AS class, round(sum((x - m) * (x - m)), 6) AS d2 FROM e JOIN m ON e.k = m.k GROUP BY e.vec_id, m.label),
    w AS MATERIALIZED (SELECT frame, class, round(exp(-d2 / 0.2::DOUBLE) / sum(exp(-d2 / 0.2::DOUBLE)) OVER (PARTITION BY frame), 5) AS weight FROM c)"""


def _best(moves: str) -> str:
    """SQL for the least cost of chains over rows mv(a, b, c) of moves."""
    return f"""
        WITH RECURSIVE {SERIES}, u AS (SELECT key, t, l, round(abs(value / 100 - l), 4) AS cost FROM s, range(5) r(l)),
        mv(a, b, c) AS (VALUES {moves}),
        v AS (SELECT key, t, l, cost FROM u WHERE t = 0
              UNION ALL SELECT v.key, v.t + 1, u.l, min(v.cost + mv.c + u.cost) FROM v JOIN mv ON mv.a = v.l JOIN u ON u.key = v.key AND u.t = v.t + 1 AND u.l = mv.b GROUP BY v.key, v.t, u.l),
        n AS (SELECT key, count(*) AS n FROM s GROUP BY key)
        SELECT v.key, round(min(v.cost), 5) AS energy, any_value(n.n) AS n FROM v JOIN n ON n.key = v.key AND v.t = n.n - 1 GROUP BY v.key"""


def _path(name: str, unary: str, before: str) -> str:
    """SQL tables of the least path ``name``(key, path, energy) over rows ``unary``(key, t, l, cost)."""
    return f"""{before}{name}_v AS (SELECT key, t, l, cost, l::VARCHAR AS path FROM {unary} WHERE t = 0
              UNION ALL SELECT v.key, v.t + 1, u.l, min(v.cost + mv.c + u.cost), arg_min(v.path, {{'c': v.cost + mv.c, 'l': v.l}}) || u.l
              FROM {name}_v v JOIN mv ON mv.a = v.l JOIN {unary} u ON u.key = v.key AND u.t = v.t + 1 AND u.l = mv.b GROUP BY v.key, v.t, u.l),
        {name} AS MATERIALIZED (SELECT v.key, arg_min(path, {{'c': cost, 'l': l}}) AS path, min(cost) AS energy FROM {name}_v v JOIN n ON n.key = v.key AND v.t = n.n - 1 GROUP BY v.key)"""


_HALF_MOVES = ", ".join(f"({a}, {b}, {c * 0.25!r}::DOUBLE)" for a, row in enumerate(MOVES) for b, c in enumerate(row))
_GREEDY = f"""
        WITH RECURSIVE {SERIES.replace('s AS (', 's AS MATERIALIZED (', 1)}, n AS MATERIALIZED (SELECT key, count(*) AS n FROM s GROUP BY key), mv(a, b, c) AS (VALUES {_HALF_MOVES}),
        u1 AS MATERIALIZED (SELECT key, t, l, 0.5::DOUBLE * round(abs(value / 100 - l), 4) AS cost FROM s, range(5) r(l)),
        {_path('one', 'u1', '')},
        u2 AS MATERIALIZED (SELECT s.key, t, l, 0.5::DOUBLE * round(abs(value / 100 + 0.3::DOUBLE - l), 4) + 0.25::DOUBLE * CASE WHEN substr(one.path, t::INTEGER + 1, 1) = l::VARCHAR THEN 2.0::DOUBLE ELSE 0 END AS cost
            FROM s JOIN one ON one.key = s.key, range(5) r(l)),
        {_path('two', 'u2', '')}
        SELECT s.key, s.t, substr(one.path, s.t::INTEGER + 1, 1)::INTEGER AS one, substr(two.path, s.t::INTEGER + 1, 1)::INTEGER AS two, round(two.energy, 5) AS energy
        FROM s JOIN one ON one.key = s.key JOIN two ON two.key = s.key"""

#: All pairs of labels at once: the product of the two chains.
_JOINT = f"""
        WITH RECURSIVE {SERIES.replace('s AS (', 's AS MATERIALIZED (', 1)}, n AS MATERIALIZED (SELECT key, count(*) AS n FROM s GROUP BY key), mv(a, b, c) AS (VALUES {_HALF_MOVES}),
        u AS MATERIALIZED (SELECT key, t, x.l AS one, y.l AS two, 0.5::DOUBLE * round(abs(value / 100 - x.l), 4) + 0.5::DOUBLE * round(abs(value / 100 + 0.3::DOUBLE - y.l), 4) + CASE WHEN x.l = y.l THEN 0.5::DOUBLE ELSE 0 END AS cost
            FROM s, range(5) x(l), range(5) y(l)),
        v AS (SELECT key, t, one, two, cost FROM u WHERE t = 0
              UNION ALL SELECT v.key, v.t + 1, u.one, u.two, min(v.cost + p.c + q.c + u.cost) FROM v JOIN mv p ON p.a = v.one JOIN mv q ON q.a = v.two
                  JOIN u ON u.key = v.key AND u.t = v.t + 1 AND u.one = p.b AND u.two = q.b GROUP BY v.key, v.t, u.one, u.two)
        SELECT v.key, any_value(n.n) AS n, round(min(v.cost), 4) AS energy FROM v JOIN n ON n.key = v.key AND v.t = n.n - 1 GROUP BY v.key"""

ORACLE_SQL = {
    "joint_synthesis": _JOINT,
    "greedy_multi": _GREEDY,
    "transition_cost": f"""
        WITH {_D}, o AS (SELECT unnest(range(-2, 3)) AS k),
        m AS (SELECT i, j, CASE WHEN i + k < 0 THEN -(i + k) WHEN i + k >= n THEN 2 * (n - 1) - (i + k) ELSE i + k END AS si,
                     CASE WHEN j + k < 0 THEN -(j + k) WHEN j + k >= n THEN 2 * (n - 1) - (j + k) ELSE j + k END AS sj FROM d, n, o),
        c AS MATERIALIZED (SELECT m.i, (m.j + 1) % any_value(n.n) AS j, round(sum(d.value), 9) AS value FROM m JOIN d ON d.i = m.si AND d.j = m.sj, n GROUP BY m.i, m.j),
        r AS (SELECT value, row_number() OVER (ORDER BY value) AS rank FROM c),
        l AS (SELECT (SELECT value FROM r WHERE rank = floor((SELECT count(*) FROM c) * 0.1::DOUBLE) + 1) AS lim, (SELECT avg(value) FROM c) * 0.5 AS sigma),
        x AS (SELECT i, j, CASE WHEN j - i <= -5 OR j - i = 1 OR j - i >= 5 THEN value ELSE 10 * value END AS value FROM c)
        SELECT i, j, round(CASE WHEN (i = n - 2 AND j = 0) OR (i = n - 1 AND j IN (0, n - 1)) THEN 0.0 WHEN value > lim THEN 1e7 ELSE exp(value / sigma) END, 4) AS value FROM x, l, n""",
    "range_prob": f"""
        WITH {_D}, m AS (SELECT avg(value) AS m FROM d WHERE value <> 0), e AS (SELECT i, j, exp(-(value / (0.5 * m))) AS v FROM d, m)
        SELECT i, j, round(v / sum(v) OVER (PARTITION BY i), 7) AS value FROM e""",
    "top_transitions": f"""
        WITH {_D}, r AS (SELECT i, j, value, row_number() OVER (PARTITION BY i ORDER BY value, j) AS rank FROM d WHERE abs(i - j) > 100 AND abs(i - j) <= 400),
        q AS (SELECT i, j, value, row_number() OVER (ORDER BY value, i, j) AS place FROM r WHERE rank <= 10)
        SELECT i, j, round(value, 5) AS value, place::INTEGER AS place FROM q WHERE place <= 50""",
    "frame_softmax": f"WITH {_SOFT} SELECT frame, class, weight FROM w",
    "semantic_likelihood": """
        SELECT vec_id AS frame, round(exp(-0.5::DOUBLE * CASE WHEN label = 3 THEN 0.0625::DOUBLE ELSE 1.5625::DOUBLE END / 0.5::DOUBLE), 5) AS value FROM embeddings""",
    "unary_cost": f"""
        WITH {SERIES}, l AS (SELECT t, key AS label, exp(-abs(value / 100 - 2)) AS v FROM s)
        SELECT t::INTEGER AS t, label, round(-ln(v / sum(v) OVER (PARTITION BY t)), 5) AS cost FROM l""",
    "viterbi_path": _best(", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, row in enumerate(MOVES) for b, c in enumerate(row))),
    "sparse_viterbi": _best(", ".join(f"({a}, {b}, {c}::DOUBLE)" for a, b, c in EDGES)),
    "future_cost_fixed_k": f"""
        WITH {_D}, q AS (SELECT i, j, value * value AS c FROM d WHERE i <> j),
        m0 AS (SELECT i, min(c) AS m FROM q GROUP BY i),
        m1 AS (SELECT q.i, min(c + 0.9::DOUBLE * m) AS m FROM q JOIN m0 ON m0.i = q.j GROUP BY q.i),
        m2 AS (SELECT q.i, min(c + 0.9::DOUBLE * m) AS m FROM q JOIN m1 ON m1.i = q.j GROUP BY q.i),
        m3 AS (SELECT q.i, min(c + 0.9::DOUBLE * m) AS m FROM q JOIN m2 ON m2.i = q.j GROUP BY q.i)
        SELECT q.i, q.j, round(c + 0.9::DOUBLE * m, 5) AS value FROM q JOIN m3 ON m3.i = q.j""",
    "geodesic_cost": f"""
        WITH {_D}, e AS (SELECT i, j, pow(value, 4) AS w FROM d WHERE abs(i - j) >= 3),
        s0 AS (SELECT 0::BIGINT AS k, 0.0::DOUBLE AS v),
        s1 AS (SELECT k, min(v) AS v FROM (SELECT j AS k, v + w AS v FROM e JOIN s0 ON e.i = s0.k UNION ALL SELECT k, v FROM s0) GROUP BY k),
        s2 AS (SELECT k, min(v) AS v FROM (SELECT j AS k, v + w AS v FROM e JOIN s1 ON e.i = s1.k UNION ALL SELECT k, v FROM s1) GROUP BY k),
        s3 AS (SELECT k, min(v) AS v FROM (SELECT j AS k, v + w AS v FROM e JOIN s2 ON e.i = s2.k UNION ALL SELECT k, v FROM s2) GROUP BY k)
        SELECT k AS "at", round(v, 5) AS value FROM s3""",
    "compat_labelprob": f"WITH {_SOFT} SELECT a.frame AS i, b.frame AS j, round(a.weight * b.weight * 100, 8) AS value FROM w a, w b WHERE a.class = 0 AND b.class = 1",
    "compat_kernel": f"""
        WITH {_D}, g AS (SELECT round(median(value), 6) AS s FROM d)
        SELECT a.j AS i, b.j, round(exp(-a.value / (2 * s * s)) * exp(-b.value / (2 * s * s)), 5) AS value FROM d a, d b, g WHERE a.i = 0 AND b.i = 7""",
    "label_prop_k_iters": f"""
        WITH {_D}, w AS (SELECT i, j, exp(-value / 0.06::DOUBLE) AS w FROM d WHERE i <> j AND i % 10 <> 0), t AS (SELECT i, sum(w) AS t FROM w GROUP BY i),
        f0 AS (SELECT vec_id AS frame, label AS class, 1.0::DOUBLE AS v FROM embeddings WHERE vec_id % 10 = 0),
        f1 AS (SELECT w.i AS frame, class, sum(w * v) / any_value(t) AS v FROM w JOIN f0 ON f0.frame = w.j JOIN t ON t.i = w.i GROUP BY w.i, class UNION ALL SELECT * FROM f0),
        f2 AS (SELECT w.i AS frame, class, sum(w * v) / any_value(t) AS v FROM w JOIN f1 ON f1.frame = w.j JOIN t ON t.i = w.i GROUP BY w.i, class UNION ALL SELECT * FROM f0),
        f3 AS (SELECT w.i AS frame, class, sum(w * v) / any_value(t) AS v FROM w JOIN f2 ON f2.frame = w.j JOIN t ON t.i = w.i GROUP BY w.i, class UNION ALL SELECT * FROM f0)
        SELECT frame, class, round(v, 5) AS value FROM f3""",
}
