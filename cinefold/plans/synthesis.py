"""Queries over the synthesis of sequences, with their SQL.

Each label's frames are a semantic sequence: frames in order, with the first three components as class weights.
"""

from __future__ import annotations

from math import log, pi

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.operators import inference, synthesis
from cinefold.plans.costs import CLASH, MOVES, _chains
from cinefold.plans.pairwise import frames, series
from cinefold.session import table

LENGTH, VARIANCE = 12, 0.05


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, frame, weights, e): the place of each frame in its label's sequence."""
    place = (F.row_number().over(W.partitionBy("label").orderBy("frame")) - 1).cast("long")
    weights = F.transform(F.slice("pixels", 1, 3), lambda x: F.round(x.cast("double"), 6))
    return frames(spark, sf_dir).select(F.col("label").alias("key"), place.alias("frame"), weights.alias("weights"), F.round(F.col("pixels")[9].cast("double"), 6).alias("e"))


def _wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, t, weights): a sequence's own weights at every fourth frame, as far as they go."""
    return _sequences(spark, sf_dir).where((F.col("frame") % 4 == 0) & (F.col("frame") < 4 * LENGTH)).select("key", (F.col("frame") / 4).cast("int").alias("t"), "weights")


def _jump(i: np.ndarray, ei: np.ndarray, j: np.ndarray, ej: np.ndarray) -> np.ndarray:
    """How far two frames' tenth components, of six digits, are apart; cheap to the next frame."""
    millionths = np.abs(np.rint(ei * 1e6) - np.rint(ej * 1e6))
    return np.where(j == i + 1, millionths, 5 * millionths) / 1e6


def chain_unaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sequences(spark, sf_dir)
    found = synthesis.chain_unaries(rows, rows.where("frame = 1").select("key", F.lit(0).alias("t"), "weights"), 3, start=1)
    return found.withColumn("cost", F.round("cost", 4))


def chain_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.chain_moves(_sequences(spark, sf_dir)).select("key", "i", "j", "cost")


def instance_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each label's frames of least cost for the wanted weights, from frame 2 on, with two cells banned."""
    rows, wanted = _sequences(spark, sf_dir), synthesis.padded(_wanted(spark, sf_dir), 0, LENGTH)
    banned = rows.where("frame = 4").select("key", F.explode(F.array(F.lit(1), F.lit(2))).alias("t"), "frame")
    costs = synthesis.likelihood_costs(rows, wanted, VARIANCE, F.lit(2), banned).withColumn("cost", F.round("cost", 6))
    return synthesis.paths_between(costs, _sequences(spark, sf_dir).select("key", "frame", F.col("e").alias("value")), _jump).withColumn("energy", F.round("energy", 6))


def wanted_padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = synthesis.padded(_wanted(spark, sf_dir), 8, 10)
    return found.select("key", "t", *[F.col("weights")[k].alias(f"weight{k}") for k in range(3)])


def sequence_extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users have seen up to the tenth event, and then every user's own events once more."""
    rows = series(spark, sf_dir).select("key", "t", F.col("event_id").alias("frame"))
    return synthesis.extended(rows, rows, 10)


def tail_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' numbers and pieces as two sequences' frames, a pair an order, run on to the ends of ten and twelve frames."""
    place = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity")) - 1
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), place.alias("t"), (F.col("l_linenumber") - 2).cast("long").alias("a"), (F.col("l_suppkey") % 9 - 1).alias("b"))
    return synthesis.tail_aligned(lines, lines.select("key", F.lit(10).alias("a_length"), F.lit(12).alias("b_length")).distinct())


def path_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths over every third frame, a user's events by their value, run through again; the first two frames are over."""
    rows = series(spark, sf_dir).select("key", "t", F.floor(F.col("value") / 50).alias("frame"))
    return synthesis.expanded(rows, 3, F.lit(2))


def rotation_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least energy a user of the rotation of two conflicting instances, after a fixed one, that costs least in all."""
    made = {0: _chains(spark, sf_dir), 1: _chains(spark, sf_dir, 0.3), 2: _chains(spark, sf_dir, 0.6)}

    def solve(order: list[int]) -> tuple[float, DataFrame]:
        out = inference.greedy([made[i] for i in order], MOVES, CLASH, 0.5, 0.5)
        last = out[-1].groupBy("key").agg(F.max("energy").alias("energy"))
        return round(last.agg(F.sum("energy")).first()[0], 6), last

    order, cost, found = synthesis.best_rotation([1, 2], [0], solve)
    return found.select("key", F.round("energy", 4).alias("energy"), F.lit(order[-1]).alias("last"))


QUERIES = {
    f.__name__: f
    for f in (chain_unaries, chain_moves, instance_path, wanted_padded, sequence_extended, tail_aligned, path_expanded, rotation_costs)
}

_S = """c AS MATERIALIZED (SELECT vec_id, label, round(embedding[1]::DOUBLE, 6) AS w1, round(embedding[2]::DOUBLE, 6) AS w2, round(embedding[3]::DOUBLE, 6) AS w3, round(embedding[10]::DOUBLE, 6) AS e FROM embeddings),
    s AS MATERIALIZED (SELECT a.label AS key, count(b.vec_id) AS frame, any_value(a.w1) AS w1, any_value(a.w2) AS w2, any_value(a.w3) AS w3, any_value(a.e) AS e
        FROM c a LEFT JOIN c b ON a.label = b.label AND b.vec_id < a.vec_id GROUP BY a.vec_id, a.label)"""
_GAP = "(pow(w1 - g1, 2) + pow(w2 - g2, 2) + pow(w3 - g3, 2))"
_W = f"""{_S}, n AS MATERIALIZED (SELECT key, (frame / 4)::INTEGER AS t, w1, w2, w3 FROM s WHERE frame % 4 = 0 AND frame < {4 * LENGTH}),
    l AS (SELECT key, arg_max(w1, t) AS f1, arg_max(w2, t) AS f2, arg_max(w3, t) AS f3 FROM n GROUP BY key)"""


def _padded(low: int, high: int) -> str:
    return f"SELECT l.key, x.t, coalesce(w1, f1) AS g1, coalesce(w2, f2) AS g2, coalesce(w3, f3) AS g3 FROM l CROSS JOIN range({low}, {high}) x(t) LEFT JOIN n ON n.key = l.key AND n.t = x.t"


_V = "SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, event_id, value FROM events"

ORACLE_SQL = {
    "chain_unaries": f"""
        WITH {_S}, g AS (SELECT key, w1 AS g1, w2 AS g2, w3 AS g3 FROM s WHERE frame = 1), q AS (SELECT key, count(*) AS n FROM s GROUP BY key)
        SELECT s.key, t::INTEGER AS t, s.frame, round(CASE WHEN t = 0 AND s.frame = 1 THEN 0 WHEN t = 0 THEN 1e7 ELSE
            ln(n * 3) + {1.5 * (log(2 * pi) + log(0.001))!r}::DOUBLE + {_GAP} / 0.002::DOUBLE END, 4) AS cost
        FROM s JOIN g ON g.key = s.key JOIN q ON q.key = s.key, range(3) r(t)""",
    "chain_moves": f"""
        WITH {_S}, m AS (SELECT key, max(frame) AS m FROM s GROUP BY key)
        SELECT a.key, a.frame AS i, b.frame AS j, CASE WHEN b.frame = a.frame + 1 OR a.frame = 0 AND b.frame = 0 OR a.frame = m AND b.frame <= 1 THEN 0.0 ELSE 1e7 END::DOUBLE AS cost
        FROM s a JOIN s b ON a.key = b.key JOIN m ON m.key = a.key""",
    "wanted_padded": f"WITH {_W}, g AS ({_padded(8, 18)}) SELECT key, t::INTEGER AS t, g1 AS weight0, g2 AS weight1, g3 AS weight2 FROM g",
    "instance_path": f"""
        WITH RECURSIVE {_W}, g AS MATERIALIZED ({_padded(0, LENGTH)}),
        p AS (SELECT s.key, g.t, s.frame, exp(-{_GAP} / {2 * VARIANCE!r}::DOUBLE) AS p FROM s JOIN g ON g.key = s.key),
        u AS MATERIALIZED (SELECT key, t, frame, round(CASE WHEN t = 0 AND frame = 2 THEN 0 WHEN t = 0 OR frame = 4 AND t <= 2 THEN 1e7 ELSE -ln(p / sum(p) OVER (PARTITION BY key, t)) END, 6) AS c FROM p),
        mv AS MATERIALIZED (SELECT a.key, a.frame AS i, b.frame AS j, round(abs(a.e - b.e) * CASE WHEN b.frame = a.frame + 1 THEN 1 ELSE 5 END, 6) AS c FROM s a JOIN s b ON a.key = b.key),
        v AS (SELECT key, t, frame, c, frame::VARCHAR AS path FROM u WHERE t = 0
              UNION ALL SELECT v.key, v.t + 1, u.frame, min(v.c + mv.c + u.c), arg_min(v.path, v.c + mv.c + u.c) || ',' || u.frame
              FROM v JOIN mv ON mv.key = v.key AND mv.i = v.frame JOIN u ON u.key = v.key AND u.t = v.t + 1 AND u.frame = mv.j GROUP BY v.key, v.t, u.frame),
        z AS (SELECT key, min(c) AS energy, arg_min(path, c) AS path FROM v WHERE t = {LENGTH - 1} GROUP BY key)
        SELECT key, unnest(range({LENGTH})) AS t, unnest(string_split(path, ','))::BIGINT AS frame, round(energy, 6) AS energy FROM z""",
    "sequence_extended": f"""
        WITH s AS ({_V}) SELECT key, t, event_id AS frame FROM s WHERE t <= 10 UNION ALL SELECT key, t + 10, event_id FROM s WHERE t > 0""",
    "tail_aligned": """
        WITH l AS (SELECT l_orderkey AS key, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey, l_quantity) - 1 AS t, l_linenumber - 2 AS a, l_suppkey % 9 - 1 AS b FROM lineitem),
        x AS (SELECT key, bool_or(a >= 0 AND b >= 0) AS shown, max(t) AS t, arg_max(a, t) AS a, arg_max(b, t) AS b FROM l GROUP BY key),
        r AS (SELECT key, t, a, b, unnest(range(1, greatest(10 - a, 12 - b))) AS k FROM x WHERE shown),
        w AS (SELECT l.* FROM l JOIN x ON x.key = l.key AND x.shown UNION ALL SELECT key, t + k, a + k, b + k FROM r)
        SELECT key, t, a, b FROM w WHERE a >= 0 AND b >= 0 AND a < 10 AND b < 12""",
    "path_expanded": f"""
        WITH s AS (SELECT key, t, floor(value / 50)::BIGINT AS f FROM ({_V})), n AS (SELECT *, lead(f) OVER (PARTITION BY key ORDER BY t) AS g FROM s),
        e AS (SELECT key, t, f, unnest(range(CASE WHEN g IS NOT NULL AND g <> f + 1 THEN 1 ELSE 3 END)) AS k FROM n)
        SELECT key, row_number() OVER (PARTITION BY key ORDER BY t, k) - 1 AS t, f * 3 + k AS frame FROM e WHERE t > 0 OR k >= 2""",
}
