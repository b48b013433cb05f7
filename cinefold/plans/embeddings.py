"""Queries on embeddings in the plane, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import distance, embed, models
from cinefold.plans.pairwise import frames

#: Neighbours a frame is tied to, the variance of their affinities, and rounds of t-SNE and of majorisation.
NEAR, WIDTH, STEPS, SWEEPS = 5, 0.5, 2, 4


def _start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames at their first two components."""
    return frames(spark, sf_dir).select(F.col("frame").alias("i"), F.col("pixels")[0].cast("double").alias("x"), F.col("pixels")[1].cast("double").alias("y"))


def _near(spark: SparkSession, sf_dir: str, k: int = NEAR) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.nearest(rows, rows, k, skip_self=True).select(F.col("frame").alias("i"), F.col("neighbour").alias("j"), "d2")


def tsne_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames after two exact rounds of t-SNE on Gaussian affinities of their nearest frames."""
    shares = _near(spark, sf_dir).select("i", "j", F.exp(-F.col("d2") / WIDTH).alias("value"))
    moved = embed.tsne(_start(spark, sf_dir), embed.symmetric(shares), STEPS, angle=0.0)
    return moved.select(F.col("i").alias("frame"), F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def tsne_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames after four rounds of t-SNE at a perplexity of 10 over their 30 nearest, with cells opened by an angle of 0.5."""
    shares = models.perplexity_rows(_near(spark, sf_dir, 30).withColumnRenamed("d2", "value"), 10.0)
    return embed.tsne(_start(spark, sf_dir), embed.symmetric(shares), 4).withColumnRenamed("i", "frame")


def _ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame and its nearest ones, each pair once; they should be as far apart as their pixels are."""
    near = _near(spark, sf_dir).select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.sqrt("d2").alias("target"))
    return near.groupBy("i", "j").agg(F.max("target").alias("target"), F.count("*").cast("double").alias("weight"))


def stress_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames placed by four rounds of majorisation."""
    _, points = embed.stress_rounds(_start(spark, sf_dir), _ties(spark, sf_dir), SWEEPS)
    return points.select(F.col("i").alias("frame"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def stress_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stress before each round and after the last, and whether it has risen."""
    record, _ = embed.stress_rounds(_start(spark, sf_dir), _ties(spark, sf_dir), SWEEPS)
    rows = [(k, round(s, 5), k > 0 and s > record[k - 1]) for k, s in enumerate(record)]
    return spark.createDataFrame(rows, "round int, stress double, risen boolean")


QUERIES = {f.__name__: f for f in (tsne_steps, tsne_map, stress_map, stress_record)}

_NEAR = f"""
    f AS MATERIALIZED (SELECT vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings),
    d AS MATERIALIZED (SELECT a.i, b.i AS j, list_sum(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM f a JOIN f b ON a.i <> b.i),
    near AS MATERIALIZED (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY i ORDER BY d2, j) <= {NEAR})"""


def _step(k: int) -> str:
    """SQL tables of one round of t-SNE: all pairs ``q``, slopes ``g``, the points ``s`` after it."""
    change = ", ".join(
        f"greatest(0.01::DOUBLE, CASE WHEN (g{c} > 0) <> (v{c} > 0) THEN k{c} + 0.2::DOUBLE ELSE k{c} * 0.8::DOUBLE END) AS k{c}, g{c}, v{c}, {c}" for c in "xy")
    moved = ", ".join(f"k{c}, 0.5::DOUBLE * v{c} - 500 * k{c} * g{c} AS v{c}, {c}" for c in "xy")
    return f"""
    q{k} AS MATERIALIZED (SELECT a.i, b.i AS j, a.x - b.x AS dx, a.y - b.y AS dy, 1 / (1 + (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS q FROM s{k} a JOIN s{k} b ON a.i <> b.i),
    g{k} AS (SELECT q.i, sum((4 * coalesce(p.v, 0) - q / (SELECT sum(q) FROM q{k})) * q * dx) AS gx, sum((4 * coalesce(p.v, 0) - q / (SELECT sum(q) FROM q{k})) * q * dy) AS gy
        FROM q{k} q LEFT JOIN p ON p.i = q.i AND p.j = q.j GROUP BY q.i),
    h{k} AS (SELECT i, {change} FROM s{k} JOIN g{k} USING (i)), m{k} AS (SELECT i, {moved} FROM h{k}),
    s{k + 1} AS MATERIALIZED (SELECT i, kx, ky, vx, vy, x + vx - avg(x + vx) OVER () AS x, y + vy - avg(y + vy) OVER () AS y FROM m{k})"""


_STRESS = f"""
    WITH RECURSIVE {_NEAR},
    t AS MATERIALIZED (SELECT least(i, j) AS i, greatest(i, j) AS j, max(sqrt(d2)) AS target, count(*) AS w FROM near GROUP BY ALL),
    b AS MATERIALIZED (SELECT i, j, target, w FROM t UNION ALL SELECT j, i, target, w FROM t),
    r AS (SELECT 0 AS k, i, e[1] AS x, e[2] AS y FROM f
        UNION ALL SELECT any_value(k) + 1, i, sum(w * ((x + ox) + ratio * (x - ox)) / 2) / sum(w), sum(w * ((y + oy) + ratio * (y - oy)) / 2) / sum(w) FROM
            (SELECT p.k, p.i, p.x, p.y, o.x AS ox, o.y AS oy, b.w, b.target / sqrt((p.x - o.x) * (p.x - o.x) + (p.y - o.y) * (p.y - o.y)) AS ratio
             FROM r p JOIN b ON b.i = p.i JOIN r o ON o.i = b.j WHERE p.k < {SWEEPS}) GROUP BY i)"""

ORACLE_SQL = {
    "tsne_steps": f"""
    WITH {_NEAR}, w AS (SELECT i, j, exp(-d2 / {WIDTH}::DOUBLE) AS v FROM near), u AS (SELECT i, j, v FROM w UNION ALL SELECT j, i, v FROM w),
    p AS MATERIALIZED (SELECT i, j, sum(v) / (SELECT sum(v) FROM u) AS v FROM u GROUP BY i, j),
    s0 AS (SELECT i, 1::DOUBLE AS kx, 1::DOUBLE AS ky, 0::DOUBLE AS vx, 0::DOUBLE AS vy, e[1] AS x, e[2] AS y FROM f), {','.join(map(_step, range(STEPS)))}
    SELECT i AS frame, round(x, 5) AS x, round(y, 5) AS y FROM s{STEPS}""",
    "stress_map": f"{_STRESS} SELECT i AS frame, round(x, 6) AS x, round(y, 6) AS y FROM r WHERE k = {SWEEPS}",
    "stress_record": f"""{_STRESS},
    z AS (SELECT a.k, sum(w * pow(sqrt(pow(a.x - o.x, 2) + pow(a.y - o.y, 2)) - target, 2)) AS s FROM t JOIN r a ON a.i = t.i JOIN r o ON o.i = t.j AND o.k = a.k GROUP BY a.k)
    SELECT k::INTEGER AS round, round(s, 5) AS stress, coalesce(s > lag(s) OVER (ORDER BY k), false) AS risen FROM z""",
}
