"""Queries over boxes, lines, space geometry and single-value functions, with their SQL."""

from __future__ import annotations

from math import cos, sin, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.functions import boxes, curves, geometry
from cinefold.operators import cost
from cinefold.plans.pairwise import frames
from cinefold.session import table

MATRIX = [[1.0, 0.1, 0.0, 0.2], [0.0, 1.0, 0.3, -0.1], [0.2, 0.0, 1.0, 0.0], [0.1, 0.0, 0.2, 2.0]]
AXIS, ANGLE = (1.0, 2.0, 2.0), 0.7
MEAN, COVARIANCE = [0.1, -0.1], [[0.5, 0.1], [0.1, 0.25]]
CORNERS = [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1)]


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with their components at six digits."""
    return frames(spark, sf_dir).select(F.col("frame").alias("id"), "label", F.transform("pixels", lambda x: F.round(x.cast("double"), 6)).alias("e"))


def _c(k: int) -> Column:
    return F.col("e")[k - 1]


def _xy(k: int) -> tuple[Column, Column]:
    return _c(k), _c(k + 1)


def _value(spark: SparkSession, sf_dir: str, value: Column, digits: int = 5) -> DataFrame:
    return _rows(spark, sf_dir).select("id", F.round(value, digits).alias("value"))


def _boxes() -> tuple[Column, Column]:
    """A box of each frame that is upright, and one that is turned."""
    size = lambda k: 0.05 + F.abs(_c(k))
    return boxes.oriented(_c(1), _c(2), size(3), size(4), F.lit(0.0)), boxes.oriented(_c(5), _c(6), size(7), size(8), F.lit(0.2) + F.abs(_c(9)))


def _boxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames with an upright box, first, and a turned one, second."""
    first, second = _boxes()
    return _rows(spark, sf_dir).withColumns({"first": first, "second": second})


def box_pair_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes.box_pair_distance(_boxed(spark, sf_dir), F.col("first"), F.col("second"), "value")
    return found.select("id", F.round("value", 5).alias("value"))


def rotated_box_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both boxes turned by an angle first; every seventh frame's against itself."""
    other = F.when(F.col("id") % 7 == 0, F.col("first")).otherwise(F.col("second"))
    found = boxes.rotated_box_distance(_boxed(spark, sf_dir), F.lit(0.3), F.col("first"), other, "value")
    return found.select("id", F.round("value", 5).alias("value"))


def line_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the line through two points of each frame meets a square's edges."""
    point = lambda p: boxes.point(*map(F.lit, p))
    edges = F.array(*[F.struct(point(a).alias("a"), point(b).alias("b")) for a, b in zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)])
    found = boxes.line_hits(_rows(spark, sf_dir), (boxes.point(*_xy(1)), boxes.point(*_xy(3))), edges)
    return found.select("id", "segment", *[F.round(c, 5).alias(c) for c in "xy"])


def grid_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole points inside each frame's triangle of three points, fifty times as large."""
    corner = lambda k: boxes.point(50 * _c(k), 50 * _c(k + 1))
    return boxes.grid_points(_rows(spark, sf_dir).select(F.col("id").alias("key"), corner(1).alias("a"), corner(3).alias("b"), corner(5).alias("c")))


def edge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _boxed(spark, sf_dir).select("id", F.posexplode(boxes.edge_samples("second", 3)).alias("k", "p"))
    return found.select("id", "k", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


def box_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxed(spark, sf_dir).withColumn("amounts", F.transform(F.slice("e", 10, 4), F.abs))
    found = rows.select("id", F.posexplode(boxes.rescaled("first", "amounts")).alias("k", "p"))
    return found.select("id", "k", F.round("p.x", 7).alias("x"), F.round("p.y", 7).alias("y"))


def footprint_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _boxed(spark, sf_dir).select("id", F.posexplode("second").alias("k", "p"))
    return found.select("id", "k", F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


def in_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", geometry.in_triangle(_xy(1), _xy(3), _xy(5), _xy(7)).alias("inside"))


def convex_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(spark, sf_dir).select("id", geometry.convex(_xy(1), _xy(3), _xy(5)).alias("convex"))


def line_meeting(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.intersection(_xy(1), _xy(3), _xy(5), _xy(7))
    return _rows(spark, sf_dir).select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


def segment_foot(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.project_on_segment(_xy(1), _xy(3), _xy(5))
    return _rows(spark, sf_dir).select("id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))


def space_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.project(np.array(MATRIX), _c(1), _c(2), _c(3))
    return _rows(spark, sf_dir).select("id", *[F.round(v, 5).alias(n) for v, n in zip(out, "xyz", strict=True)])


def axis_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.project(geometry.rotation_about(AXIS, ANGLE, (0.1, 0.2, 0.3)), _c(1), _c(2), _c(3))
    return _rows(spark, sf_dir).select("id", *[F.round(v, 5).alias(n) for v, n in zip(out, "xyz", strict=True)])


def ray_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameter at which each frame's ray meets the plane through (0, 0, 1) with normal (1, 2, 2)."""
    lit = lambda *p: tuple(map(F.lit, p))
    return _value(spark, sf_dir, geometry.ray_plane(tuple(_c(k) for k in (1, 2, 3)), tuple(_c(k) for k in (4, 5, 6)), lit(0.0, 0.0, 1.0), lit(1.0, 2.0, 2.0)), 3)


def gaussian_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, curves.gaussian([_c(1), _c(2)], MEAN, COVARIANCE))


def many_means_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame's density about every label's mean point: the product of frames and labels."""
    rows = _rows(spark, sf_dir)
    means = rows.groupBy("label").agg(F.avg(_c(1)).alias("mx"), F.avg(_c(2)).alias("my")).withColumnRenamed("label", "mean")
    gap = [_c(1) - F.col("mx"), _c(2) - F.col("my")]
    return rows.crossJoin(means).select("id", "mean", F.round(curves.gaussian(gap, [0.0, 0.0], COVARIANCE, normalised=False), 5).alias("value"))


def toggle_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ramp = _rows(spark, sf_dir).select("id", F.posexplode(curves.toggle(curves.smoothstep(4), _c(1), _c(2))).alias("step", "value"))
    return ramp.withColumn("value", F.round("value", 5))


def student_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, cost.student_weight(10 * _c(1)))


def sharpened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, curves.sharpened(_c(1)))


def multi_object_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _value(spark, sf_dir, curves.multi_object_score(F.slice("e", 1, 5)))


def direction_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles of a direction, in the two orders of arguments that are in use."""
    return _rows(spark, sf_dir).select("id", F.round(F.atan2(-_c(2), _c(1)), 5).alias("image"), F.round(F.atan2(_c(1), _c(2)), 5).alias("ground"))


def unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each first component in its label's range, 0 to 1; a label without a range gives null."""
    rows = _rows(spark, sf_dir)
    range_ = rows.groupBy("label").agg(F.min(_c(1)).alias("low"), F.max(_c(1)).alias("high"))
    return rows.join(range_, "label").select("id", F.round(F.try_divide(_c(1) - F.col("low"), F.col("high") - F.col("low")), 5).alias("value"))


def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders without replacement, the same for the same seed: those whose hashes with it are least."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat(F.lit("17:"), F.col("o_orderkey").cast("string"))).alias("_hash"))
    return orders.orderBy("_hash", "o_orderkey").limit(50).select("o_orderkey")


def colour_wheel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(k, *hue) for k, hue in enumerate(curves.colour_wheel())]
    return spark.createDataFrame(rows, "k int, red int, green int, blue int")


QUERIES = {
    f.__name__: f
    for f in (
        box_pair_distance, rotated_box_distance, line_hits, grid_points, edge_samples, box_rescaled, footprint_corners, in_triangle, convex_turn, line_meeting, segment_foot, space_projection,
        axis_rotation, ray_hit, gaussian_density, many_means_density, toggle_ramp, student_weight, sharpened, multi_object_score, direction_angles, unit_range, random_sample, colour_wheel,
    )
}

_Q = "q AS (SELECT vec_id AS id, label, list_transform(embedding, lambda v: round(v::DOUBLE, 6)) AS e FROM embeddings)"
_R = f"WITH {_Q}, r AS (SELECT id, label, " + ", ".join(f"e[{k}] AS e{k}" for k in range(1, 14)) + " FROM q)"
_TEMPLATE = "t(k, sx, sy) AS (VALUES (0, -0.5::DOUBLE, -0.5::DOUBLE), (1, 0.5, -0.5), (2, 0.5, 0.5), (3, -0.5, 0.5))"


def _box(name: str, cx: str, cy: str, w: str, h: str, angle: str) -> str:
    return f"""{name} AS (SELECT id, k, {cx} + cos({angle}) * sx * (0.05::DOUBLE + abs({w})) - sin({angle}) * sy * (0.05::DOUBLE + abs({h})) AS x,
        {cy} + sin({angle}) * sx * (0.05::DOUBLE + abs({w})) + cos({angle}) * sy * (0.05::DOUBLE + abs({h})) AS y FROM r, t)"""


_UPRIGHT, _TURNED = _box("u", "e1", "e2", "e3", "e4", "0::DOUBLE"), _box("o", "e5", "e6", "e7", "e8", "(0.2::DOUBLE + abs(e9))")
_AWAY = "round(sqrt(pow(greatest(x0 - {x}, 0, {x} - x1), 2) + pow(greatest(y0 - {y}, 0, {y} - y1), 2)), 12)"


def _pair(first: str, second: str) -> str:
    """SQL of the least distance by id between upright corners and another box's edges."""
    foot_x, foot_y = "ax + s * (bx - ax)", "ay + s * (by_ - ay)"
    return f"""
        x AS (SELECT id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM {first} GROUP BY id),
        g AS (SELECT a.id, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM {second} a JOIN {second} b ON a.id = b.id AND b.k = (a.k + 1) % 4),
        f AS (SELECT g.*, c.k AS c, ((c.x - ax) * (bx - ax) + (c.y - ay) * (by_ - ay)) / (pow(bx - ax, 2) + pow(by_ - ay, 2)) AS s FROM g JOIN {first} c ON c.id = g.id WHERE bx <> ax),
        d AS (SELECT f.*, {_AWAY.format(x=f"({foot_x})", y=f"({foot_y})")} AS away, least({_AWAY.format(x="ax", y="ay")}, {_AWAY.format(x="bx", y="by_")}) AS ends FROM f JOIN x ON x.id = f.id),
        n AS (SELECT *, row_number() OVER (PARTITION BY id, k ORDER BY away, c) AS place FROM d),
        z AS (SELECT id, min(CASE WHEN s > 0 AND s < 1 THEN away ELSE ends END) AS value FROM n WHERE place = 1 GROUP BY id)"""


_ROTATION = [[float(x) for x in row] for row in geometry.rotation_about(AXIS, ANGLE, (0.1, 0.2, 0.3))]


def _projected(m: list[list[float]]) -> str:
    rows = [f"({a!r}::DOUBLE * e1 + {b!r}::DOUBLE * e2 + {c!r}::DOUBLE * e3 + {d!r}::DOUBLE)" for a, b, c, d in m]
    return ", ".join(f"round({rows[k]} / {rows[3]}, 5) AS {n}" for k, n in enumerate("xyz"))


_DET = 0.5 * 0.25 - 0.01
_FORM = f"(0.25::DOUBLE * a * a - 0.2::DOUBLE * a * b + 0.5::DOUBLE * b * b) / {_DET!r}::DOUBLE"
_CROSS = lambda o, q: f"((e{q} - e{o}) * (e2 - e{o + 1}) - (e{q + 1} - e{o + 1}) * (e1 - e{o}))"
_RAMP = "6 * pow(i / 5::DOUBLE, 5) - 15 * pow(i / 5::DOUBLE, 4) + 10 * pow(i / 5::DOUBLE, 3)"
_EDGES = ", ".join(f"({k}, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE)" for k, (a, b) in enumerate(zip(CORNERS, CORNERS[1:] + CORNERS[:1], strict=True)))
_AWAY_FROM_ZERO = lambda c: f"(CASE WHEN {c} > 0 THEN 1 ELSE -1 END * ceil(abs({c})))"
_TRI = lambda o, q: f"(({q}x - {o}x) * (y - {o}y) - ({q}y - {o}y) * (x - {o}x))"

ORACLE_SQL = {
    "box_pair_distance": f"{_R}, {_TEMPLATE}, {_UPRIGHT}, {_TURNED}, {_pair('u', 'o')} SELECT id, round(value, 5) AS value FROM z",
    "rotated_box_distance": f"""
        {_R}, {_TEMPLATE}, {_UPRIGHT}, {_TURNED}, s AS (SELECT * FROM o WHERE id % 7 <> 0 UNION ALL SELECT * FROM u WHERE id % 7 = 0),
        u2 AS (SELECT id, k, {cos(0.3)!r}::DOUBLE * x - {sin(0.3)!r}::DOUBLE * y AS x, {sin(0.3)!r}::DOUBLE * x + {cos(0.3)!r}::DOUBLE * y AS y FROM u),
        s2 AS (SELECT id, k, {cos(0.3)!r}::DOUBLE * x - {sin(0.3)!r}::DOUBLE * y AS x, {sin(0.3)!r}::DOUBLE * x + {cos(0.3)!r}::DOUBLE * y AS y FROM s),
        {_pair('u2', 's2')} SELECT id, CASE WHEN id % 7 = 0 THEN 0 ELSE round(value, 5) END AS value FROM z""",
    "line_hits": f"""
        {_R}, g(segment, ax, ay, bx, by_) AS (VALUES {_EDGES}),
        m AS (SELECT id, segment, e1, e2, e3, e4, ax, ay, bx, by_, ((ax - e1) * (by_ - ay) - (ay - e2) * (bx - ax)) / nullif((e3 - e1) * (by_ - ay) - (e4 - e2) * (bx - ax), 0) AS t FROM r, g),
        p AS (SELECT *, e1 + t * (e3 - e1) AS x, e2 + t * (e4 - e2) AS y FROM m WHERE t IS NOT NULL)
        SELECT id, segment, round(x, 5) AS x, round(y, 5) AS y FROM p
        WHERE abs(sqrt(pow(x - ax, 2) + pow(y - ay, 2)) + sqrt(pow(x - bx, 2) + pow(y - by_, 2)) - sqrt(pow(ax - bx, 2) + pow(ay - by_, 2))) < 1e-10""",
    "grid_points": f"""
        {_R}, c AS (SELECT id, 50 * e1 AS ax, 50 * e2 AS ay, 50 * e3 AS bx, 50 * e4 AS by_, 50 * e5 AS cx, 50 * e6 AS cy FROM r),
        b AS (SELECT id, ax AS p_x, ay AS p_y, bx AS q_x, by_ AS q_y, cx AS w_x, cy AS w_y, {_AWAY_FROM_ZERO("least(ax, bx, cx)")} AS x0, {_AWAY_FROM_ZERO("greatest(ax, bx, cx)")} AS x1,
                     {_AWAY_FROM_ZERO("least(ay, by_, cy)")} AS y0, {_AWAY_FROM_ZERO("greatest(ay, by_, cy)")} AS y1 FROM c),
        xs AS (SELECT *, unnest(range(x0::BIGINT, x1::BIGINT + 1)) AS x FROM b), ys AS (SELECT *, unnest(range(y0::BIGINT, y1::BIGINT + 1)) AS y FROM xs),
        g AS (SELECT id, x, y, {_TRI('p_', 'q_')} AS s1, {_TRI('q_', 'w_')} AS s2, {_TRI('w_', 'p_')} AS s3 FROM ys)
        SELECT id AS key, x::DOUBLE AS x, y::DOUBLE AS y FROM g WHERE least(s1, s2, s3) > 0 OR greatest(s1, s2, s3) < 0""",
    "edge_samples": f"""
        {_R}, {_TEMPLATE}, {_TURNED}, g AS (SELECT a.id, a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM o a JOIN o b ON a.id = b.id AND b.k = (a.k + 1) % 4),
        s AS (SELECT *, unnest(range(4)) AS i FROM g) SELECT id, (4 * k + i)::INTEGER AS k, round(ax + i / 3 * (bx - ax), 5) AS x, round(ay + i / 3 * (by_ - ay), 5) AS y FROM s""",
    "box_rescaled": f"""
        {_R}, {_TEMPLATE}, {_UPRIGHT}, v AS (SELECT a.id, a.k, a.x, a.y, (a.x - b.x) / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dx, (a.y - b.y) / sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS dy
            FROM u a JOIN u b ON a.id = b.id AND b.k = (a.k + 3) % 4),
        w AS (SELECT v.*, abs([e10, e11, e12, e13][v.k + 1]) AS m FROM v JOIN r ON r.id = v.id)
        SELECT a.id, a.k, round(a.x + a.dx * a.m + b.dx * b.m, 7) AS x, round(a.y + a.dy * a.m + b.dy * b.m, 7) AS y FROM w a JOIN w b ON a.id = b.id AND b.k = (a.k + 3) % 4""",
    "footprint_corners": f"{_R}, {_TEMPLATE}, {_TURNED} SELECT id, k, round(x, 5) AS x, round(y, 5) AS y FROM o",
    "in_triangle": f"""
        {_R}, s AS (SELECT id, {_CROSS(3, 5)} AS a, {_CROSS(5, 7)} AS b, {_CROSS(7, 3)} AS c FROM r) SELECT id, least(a, b, c) > 0 OR greatest(a, b, c) < 0 AS inside FROM s""",
    "convex_turn": f"{_R} SELECT id, (e3 - e1) * (e6 - e4) - (e4 - e2) * (e5 - e3) >= 0 AS convex FROM r",
    "line_meeting": f"""
        {_R}, t AS (SELECT *, ((e5 - e1) * (e8 - e6) - (e6 - e2) * (e7 - e5)) / ((e3 - e1) * (e8 - e6) - (e4 - e2) * (e7 - e5)) AS t FROM r)
        SELECT id, round(e1 + t * (e3 - e1), 3) AS x, round(e2 + t * (e4 - e2), 3) AS y FROM t""",
    "segment_foot": f"""
        {_R}, t AS (SELECT *, ((e1 - e3) * (e5 - e3) + (e2 - e4) * (e6 - e4)) / ((e5 - e3) * (e5 - e3) + (e6 - e4) * (e6 - e4)) AS t FROM r)
        SELECT id, round(e3 + t * (e5 - e3), 5) AS x, round(e4 + t * (e6 - e4), 5) AS y FROM t""",
    "space_projection": f"{_R} SELECT id, {_projected(MATRIX)} FROM r",
    "axis_rotation": f"{_R} SELECT id, {_projected(_ROTATION)} FROM r",
    "ray_hit": f"""
        {_R}, d AS (SELECT id, e4 * 1 + e5 * 2 + e6 * 2 AS along, -e1 * 1 - e2 * 2 + (1 - e3) * 2 AS away FROM r)
        SELECT id, CASE WHEN abs(along) > 1e-10 THEN round(away / along, 3) END AS value FROM d""",
    "gaussian_density": f"{_R}, g AS (SELECT id, e1 - 0.1::DOUBLE AS a, e2 + 0.1::DOUBLE AS b FROM r) SELECT id, round(exp(-0.5::DOUBLE * {_FORM}) / (2 * pi() * {sqrt(_DET)!r}::DOUBLE), 5) AS value FROM g",
    "many_means_density": f"""
        {_R}, m AS (SELECT label AS mean, avg(e1) AS mx, avg(e2) AS my FROM r GROUP BY label), g AS (SELECT id, mean, e1 - mx AS a, e2 - my AS b FROM r, m)
        SELECT id, mean, round(exp(-0.5::DOUBLE * {_FORM}), 5) AS value FROM g""",
    "toggle_ramp": f"{_R}, s AS (SELECT id, e1, e2, unnest(range(1, 5)) AS i FROM r) SELECT id, (i - 1)::INTEGER AS step, round(e1 + ({_RAMP}) * (e2 - e1), 5) AS value FROM s",
    "student_weight": f"{_R} SELECT id, round(pow(1 + 10 * e1 * e1, -5.5::DOUBLE), 5) AS value FROM r",
    "sharpened": f"{_R} SELECT id, round(2 / (1 + exp(-5 * e1)) - 1, 5) AS value FROM r",
    "multi_object_score": f"""
        {_Q.replace('q AS', 'WITH q AS')}, s AS (SELECT id, unnest(e[1:5]) AS s, list_max(e[1:5]) AS most FROM q) SELECT id, round(exp(-sum(pow(2 * (most - s), 2.5::DOUBLE)) / 4), 5) AS value FROM s GROUP BY id""",
    "direction_angles": f"{_R} SELECT id, round(atan2(-e2, e1), 5) AS image, round(atan2(e1, e2), 5) AS ground FROM r",
    "unit_range": f"{_R}, m AS (SELECT label, min(e1) AS low, max(e1) AS high FROM r GROUP BY label) SELECT id, round((e1 - low) / nullif(high - low, 0), 5) AS value FROM r JOIN m ON m.label = r.label",
    "random_sample": "SELECT o_orderkey FROM orders ORDER BY md5('17:' || o_orderkey), o_orderkey LIMIT 50",
    "colour_wheel": """
        WITH ramps(base, n, r, g, b, up) AS (VALUES (0, 15, 255, NULL, 0, true), (15, 6, NULL, 255, 0, false), (21, 4, 0, 255, NULL, true), (25, 11, 0, NULL, 255, false), (36, 13, NULL, 0, 255, true), (49, 6, 255, 0, NULL, false)),
        s AS (SELECT *, unnest(range(n)) AS i FROM ramps), l AS (SELECT *, CASE WHEN up THEN floor(255 * i / n) ELSE 255 - floor(255 * i / n) END::INTEGER AS level FROM s)
        SELECT (base + i)::INTEGER AS k, coalesce(r, level) AS red, coalesce(g, level) AS green, coalesce(b, level) AS blue FROM l""",
}
