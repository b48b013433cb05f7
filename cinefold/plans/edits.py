"""Queries over edits of boxes, masks, blurred densities and clusters, with their SQL."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import aggregate, edits
from cinefold.plans.pairwise import PAIRS, frames
from cinefold.session import table

SAMPLES = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.0, 0.1)]
SIGMA, BORDER, BINS = 1.5, 3, 20


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence a customer: the boxes are the orders, the frames their number divided by ten."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("key"), F.floor(F.col("o_orderkey") / 10).alias("frame"))
    rows = orders.agg(F.max("o_totalprice").alias("x"), F.min("o_totalprice").alias("y"))
    return rows.withColumns({"angle": F.lit(0.0), "path": F.concat(F.lit("f"), F.col("frame").cast("string"))})


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda k: F.round(F.col("pixels")[k].cast("double"), 6)
    return frames(spark, sf_dir).select(F.col("frame").alias("id"), part(0).alias("x"), part(1).alias("y"), part(2).alias("u"), part(3).alias("v"))


def boxes_upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One box over frames 2 to 6 of every customer, and another over 5 to 9 of every second."""
    keys = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    span = lambda rows, first, last, x, n: rows.select("key", *[F.lit(v).alias(c) for c, v in (("first", first), ("last", last), ("x", x), ("y", 1.0), ("angle", 0.5), ("path", "new"), ("n", n))])
    ranges = span(keys, 2, 6, 10.0, 1).unionByName(span(keys.where("key % 2 = 0"), 5, 9, 20.0, 2))
    return edits.upserted(_boxes(spark, sf_dir), ranges)


def boxes_ended(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.ended(_boxes(spark, sf_dir)).select("key", "frame", "x", "path")


def boxes_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the frames of orders that are done."""
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.floor(F.col("o_orderkey") / 10).alias("frame"))
    return edits.removed(_boxes(spark, sf_dir), gone).select("key", "frame", "x", "path")


def box_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame's direction on an image, and an angle of one turned by that from its first to its second direction."""
    turned = edits.turned_by(F.lit(1.0), (F.col("x"), F.col("y")), (F.col("u"), F.col("v")))
    return _points(spark, sf_dir).select("id", F.round(edits.image_angle(F.col("x"), F.col("y")), 5).alias("angle"), F.round(turned, 5).alias("turned"))


def compat_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of lines by flag and mode of status, as shares of the largest."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("i"), F.col("l_linestatus").alias("j")).agg(F.count("*").cast("double").alias("value"))
    return edits.shared_scale(lines).withColumn("value", F.round("value", 6))


def outlier_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.near_samples(_points(spark, sf_dir), SAMPLES).select("id", F.round("away", 5).alias("away"))


def density_blurred(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = aggregate.density(_points(spark, sf_dir), -0.5, -0.5, 0.5, 0.5, BINS, BINS)
    return edits.blurred(bins, BINS, BINS, BORDER, SIGMA).where("value > 1e-9").withColumn("value", F.round("value", 6))


def single_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits.single_link(frames(spark, sf_dir), 1.05)


QUERIES = {f.__name__: f for f in (boxes_upserted, boxes_ended, boxes_removed, box_angles, compat_view, outlier_mask, density_blurred, single_link)}

_B = "b AS (SELECT o_custkey AS key, floor(o_orderkey / 10)::BIGINT AS frame, max(o_totalprice) AS x, min(o_totalprice) AS y FROM orders GROUP BY 1, 2)"
_P = "p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, round(embedding[3]::DOUBLE, 6) AS u, round(embedding[4]::DOUBLE, 6) AS v FROM embeddings)"
_REACH = int(4 * SIGMA + 0.5)
_SIDE = BINS + 2 * BORDER
_WEIGHTS = [exp(-0.5 * (k / SIGMA) ** 2) for k in range(-_REACH, _REACH + 1)]
_KERNEL = ", ".join(f"({k - _REACH}, {w / sum(_WEIGHTS)!r}::DOUBLE)" for k, w in enumerate(_WEIGHTS))
_MIRROR = "CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= " + str(_SIDE) + " THEN " + str(2 * _SIDE - 1) + " - ({c}) ELSE {c} END"
_NEAREST = "least(" + ", ".join(f"sqrt(pow(x - {x}, 2) + pow(y - {y}, 2))" for x, y in SAMPLES) + ")"

ORACLE_SQL = {
    "boxes_upserted": f"""
        WITH {_B}, r AS (SELECT c_custkey AS key, unnest(range(2, 7)) AS frame, 10.0::DOUBLE AS x, 1 AS n FROM customer UNION ALL SELECT c_custkey, unnest(range(5, 10)), 20.0, 2 FROM customer WHERE c_custkey % 2 = 0),
        w AS (SELECT key, frame, arg_max(x, n) AS x FROM r GROUP BY key, frame)
        SELECT key, frame, x, y, 0.0::DOUBLE AS angle, 'f' || frame AS path FROM b ANTI JOIN w USING (key, frame) UNION ALL SELECT key, frame, x, 1.0, 0.5, 'new' FROM w""",
    "boxes_ended": f"WITH {_B} SELECT key, frame, x, 'f' || frame AS path FROM b UNION ALL SELECT key, max(frame) + 1, NULL, '' FROM b GROUP BY key",
    "boxes_removed": f"""
        WITH {_B}, g AS (SELECT DISTINCT o_custkey AS key, floor(o_orderkey / 10)::BIGINT AS frame FROM orders WHERE o_orderstatus = 'F') SELECT key, frame, x, 'f' || frame AS path FROM b ANTI JOIN g USING (key, frame)""",
    "box_angles": f"""
        WITH {_P}, a AS (SELECT *, atan2(-y, x) AS a, (x * u + y * v) / nullif(sqrt(x * x + y * y) * sqrt(u * u + v * v), 0) AS c, CASE WHEN x * v - y * u < 0 THEN -1 ELSE 1 END AS side FROM p)
        SELECT id, round(CASE WHEN a < 0 THEN a + 2 * pi() ELSE a END, 5) AS angle, round(1 + coalesce(side * acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, c))), 0), 5) AS turned FROM a""",
    "compat_view": """
        WITH c AS (SELECT l_returnflag AS i, l_linestatus AS j, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1, 2) SELECT i, j, round(value / (SELECT max(value) FROM c), 6) AS value FROM c""",
    "outlier_mask": f"WITH {_P}, d AS (SELECT id, {_NEAREST} AS away FROM p) SELECT id, round(away, 5) AS away FROM d WHERE away <= (SELECT median(away) FROM d)",
    "density_blurred": f"""
        WITH {_P}, b AS (SELECT floor((x + 0.5::DOUBLE) / 1.0::DOUBLE * {BINS})::INTEGER + {BORDER} AS bx, floor((y + 0.5::DOUBLE) / 1.0::DOUBLE * {BINS})::INTEGER + {BORDER} AS by_ FROM p),
        c AS (SELECT bx, by_, count(*)::DOUBLE AS n FROM b WHERE bx BETWEEN {BORDER} AND {BINS + BORDER - 1} AND by_ BETWEEN {BORDER} AND {BINS + BORDER - 1} GROUP BY 1, 2),
        k(k, w) AS (VALUES {_KERNEL}), g AS (SELECT x.i AS bx, y.i AS by_ FROM range({_SIDE}) x(i), range({_SIDE}) y(i)),
        m AS (SELECT g.bx, g.by_, h.w * v.w AS w, {_MIRROR.format(c="g.bx + h.k")} AS sx, {_MIRROR.format(c="g.by_ + v.k")} AS sy FROM g, k h, k v)
        SELECT m.bx::INTEGER AS bin_x, m.by_::INTEGER AS bin_y, round(sum(m.w * c.n), 6) AS value FROM m JOIN c ON c.bx = m.sx AND c.by_ = m.sy GROUP BY 1, 2 HAVING sum(m.w * c.n) > 1e-9""",
    "single_link": f"""
        WITH RECURSIVE {PAIRS}, e AS MATERIALIZED (SELECT i, j FROM p WHERE d2 <= 1.05::DOUBLE), r AS (SELECT i AS frame, j AS seen FROM e UNION SELECT r.frame, e.j FROM r JOIN e ON e.i = r.seen)
        SELECT frame, min(seen) AS cluster FROM r GROUP BY frame""",
}
