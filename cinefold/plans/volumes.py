"""Queries on volumes before a camera and on cameras' poses, with their SQL."""

from __future__ import annotations

from math import cos, sin

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.functions import volumes
from cinefold.functions.geometry import look_at
from cinefold.operators import fits
from cinefold.plans.pairwise import frames
from cinefold.session import table

CAMERA = look_at((2.5, -12.0, 9.0), (2.5, 3.0, 0.0), 900.0, (640.0, 360.0))
#: Where every fit starts.
START = (1.8, 3.4, 1.4, 0.0, 0.0, 0.0, 1.0, 1.0)
ANGLES = (0.3, -0.2, 0.5)
#: A supplier's volume, by its key k: expressions that Spark and DuckDB read alike, in the order of ``fits.PARAMETERS``.
PLANTED = ("1.5D + (k % 7) / 10D", "3D + (k % 5) / 5D", "1.2D + (k % 3) / 4D", "(k % 11) / 10D - 0.5D", "(k % 13) / 10D - 0.6D", "(k % 9) / 20D - 0.2D", "1D + (k % 4) / 20D", "1D - (k % 6) / 40D")


def _duck(expression: str) -> str:
    """An expression with DuckDB's double literals."""
    return " ".join(f"{w.rstrip(')')[:-1]}::DOUBLE" + ")" * (len(w) - len(w.rstrip(")"))) if w.rstrip(")").endswith("D") else w for w in expression.split(" "))


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier's lines as a track: price along, quantity across, discount as the turn; with the supplier's own volume."""
    return _planted(_places(spark, sf_dir))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("key"), (F.col("l_quantity").cast("double") / 10).alias("x"), (F.col("l_extendedprice").cast("double") / 20000).alias("y"), (F.col("l_discount").cast("double") * 10).alias("turn"))


def _planted(rows: DataFrame) -> DataFrame:
    return rows.withColumns({f"own_{n}": F.expr(e.replace("k ", "key ")) for n, e in zip(fits.PARAMETERS, PLANTED, strict=True)})


def _box(size: dict) -> F.Column:
    """The extent of a volume of these parameters where the track has come to."""
    turn, x, y = size["turn"], F.col("x"), F.col("y")
    along, across = F.cos(turn) * x + F.sin(turn) * y, F.cos(turn) * y - F.sin(turn) * x
    corners = volumes.placed(size["width"], size["length"], size["height"], size["x"] + along * size["stretch_x"], size["y"] + across * size["stretch_y"], turn + F.col("turn"))
    return volumes.extent(CAMERA, corners)


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _seen_in(_track(spark, sf_dir))


def _seen_in(rows: DataFrame) -> DataFrame:
    return rows.withColumn("box", _box({n: F.col(f"own_{n}") for n in fits.PARAMETERS}))


def volume_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's volume, from nothing but the boxes it was seen in."""
    rows = _observed(spark, sf_dir).select("key", "x", "y", "turn", "box.*")
    found = fits.fitted(rows, rows.select("key").distinct().withColumn("start", F.array(*map(F.lit, START))), CAMERA)
    return found.select("key", *[(F.round(F.col("fit")[k], 4) + 0.0).alias(n) for k, n in enumerate(fits.PARAMETERS)], (F.col("cost") < 1e-6).alias("met"))


def frame_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a supplier's lines have a volume, started 0.1 off its place and turn with its size held, that comes to fill its box.

    Four sides and three unknowns: where other corners make a box's sides, a descent may end beside the truth.
    """
    off = 0.1
    rows = _seen_in(_planted(_places(spark, sf_dir).distinct()))
    size = {n: F.col(f"own_{n}") for n in fits.PARAMETERS}
    turn = size["turn"]
    there = {"x": size["x"] + (F.cos(turn) * F.col("x") + F.sin(turn) * F.col("y")) * size["stretch_x"], "y": size["y"] + (F.cos(turn) * F.col("y") - F.sin(turn) * F.col("x")) * size["stretch_y"], "turn": turn + F.col("turn")}
    rows = rows.select("key", *[F.lit(0.0).alias(c) for c in ("x", "y", "turn")], "box.*",
                       F.array(*[there[n] + off if n in there else F.lit(1.0) if "stretch" in n else size[n] for n in fits.PARAMETERS]).alias("start"))
    found = fits.refined(rows, CAMERA, ["key"], held=("width", "length", "height", "stretch_x", "stretch_y"))
    return found.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("cost") < 1e-6).alias("met"))


def track_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each supplier's starting volume loses against its boxes, with the prior on its shape."""
    start = {n: F.lit(v) for n, v in zip(fits.PARAMETERS, START, strict=True)}
    rows = _observed(spark, sf_dir).withColumn("loss", volumes.extent_loss(_box(start), F.col("box")))
    prior = volumes.shape_prior(F.col("w"), F.col("l"), F.col("h"))
    sums = rows.groupBy("key").agg(F.sum("loss").alias("loss"), *[F.first(f"own_{n}").alias(n[0]) for n in fits.PARAMETERS[:3]])
    return sums.select("key", F.round("loss", 5).alias("loss"), F.round(prior, 8).alias("prior"))


def footprint_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each supplier's volume hides each of its lower corners from the camera."""
    rows = _track(spark, sf_dir)
    size = {n: F.col(f"own_{n}") for n in fits.PARAMETERS}
    eye = volumes.eye_of(CAMERA)[:2]
    rows = rows.withColumn("c", volumes.placed(size["width"], size["length"], size["height"], F.col("x"), F.col("y"), F.col("turn")))
    return rows.groupBy("key").agg(*[F.count_if(volumes.hidden(F.col("c"), k, eye)).alias(f"hidden_{k}") for k in range(4)])


def ground_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames' first components as places in the image, and the ground there."""
    u, v = 640 + 900 * F.col("pixels")[0].cast("double"), 700 + 200 * F.col("pixels")[1].cast("double")
    x, y = volumes.on_ground(CAMERA, u, v)
    ray = volumes.pixel_ray(CAMERA, u, v)
    return frames(spark, sf_dir).select("frame", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), *[F.round(r, 6).alias(f"ray_{c}") for c, r in zip("xyz", ray, strict=True)])


def homography_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pose that frames' first nine components are a homography of."""
    pose = volumes.pose_of(F.transform(F.slice("pixels", 1, 9), lambda x: x.cast("double")))
    return frames(spark, sf_dir).withColumn("pose", pose).select("frame", *[F.round(F.col("pose")[k], 6).alias(f"p{k}") for k in range(12)])


def euler_turned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames' first three components as space points, in a camera's space."""
    m = volumes.euler_extrinsics(*ANGLES)
    p = [F.col("pixels")[k].cast("double") for k in range(3)]
    return frames(spark, sf_dir).select("frame", *[F.round(sum((float(r[k]) * p[k] for k in range(3)), F.lit(float(r[3]))), 6).alias(c) for c, r in zip("xyz", m, strict=False)])


QUERIES = {f.__name__: f for f in (volume_fit, frame_refine, track_loss, footprint_hidden, ground_seen, homography_pose, euler_turned)}

_M = [[f"{x!r}::DOUBLE" for x in map(float, r)] for r in CAMERA]
_OWN = ", ".join(f"{_duck(e)} AS own_{n}" for n, e in zip(fits.PARAMETERS, PLANTED, strict=True))
_LINES = f"""
    lines AS (SELECT row_number() OVER () AS id, l_suppkey AS k, l_quantity::DOUBLE / 10 AS x, l_extendedprice::DOUBLE / 20000 AS y, l_discount::DOUBLE * 10 AS turn FROM lineitem),
    track AS MATERIALIZED (SELECT *, {_OWN} FROM lines)"""


def _corners(source: str, size: dict[str, str]) -> str:
    """SQL of a volume's corners on the ground (n: 0 to 3, up: 0 or 1), where the track has come to."""
    a, b = "CASE WHEN c IN (2, 3) THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END", "CASE WHEN c IN (1, 2) THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END"
    return f"""(SELECT id, k, c, up, px + cos(theta) * {a} * wide_l + sin(theta) * {b} * wide_w AS gx, py - sin(theta) * {a} * wide_l + cos(theta) * {b} * wide_w AS gy, up * tall AS gz FROM
        (SELECT id, k, {size['width']} AS wide_w, {size['length']} AS wide_l, {size['height']} AS tall, {size['px']} AS px, {size['py']} AS py, {size['theta']} AS theta FROM {source}), range(4) r(c), range(2) s(up))"""


def _moved(size: dict[str, str]) -> dict[str, str]:
    t = size["turn"]
    return size | {"px": f"{size['x']} + (cos({t}) * x + sin({t}) * y) * {size['stretch_x']}", "py": f"{size['y']} + (cos({t}) * y - sin({t}) * x) * {size['stretch_y']}", "theta": f"{t} + turn"}


def _seen(corners: str) -> str:
    of = lambda r: f"({r[0]} * gx + {r[1]} * gy + {r[2]} * gz + {r[3]})"
    return f"(SELECT id, k, min(u) AS l, min(v) AS t, max(u) AS r, max(v) AS b FROM (SELECT id, k, {of(_M[0])} / {of(_M[2])} AS u, {of(_M[1])} / {of(_M[2])} AS v FROM {corners}) GROUP BY id, k)"


_SELF = {n: f"own_{n}" for n in fits.PARAMETERS}
_FIRST = {n: f"{v!r}::DOUBLE" for n, v in zip(fits.PARAMETERS, START, strict=True)}
_EYE = [f"{x!r}::DOUBLE" for x in volumes.eye_of(CAMERA)[:2]]
_A, _B, _C = ANGLES


def _determinant(columns: list[list[str]]) -> str:
    (a, b, c), (d, e, f), (g, h, i) = zip(*columns, strict=True)
    return f"({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"


def _cramer(columns: list[list[str]], right: list[str]) -> list[str]:
    """SQL of the solution of three equations, by determinants."""
    whole = _determinant(columns)
    return [f"{_determinant([right if n == k else c for n, c in enumerate(columns)])} / {whole}" for k in range(3)]


_COLUMNS = [[_M[r][c] for r in range(3)] for c in range(4)]
_GROUND, _RAY = _cramer([_COLUMNS[0], _COLUMNS[1], _COLUMNS[3]], ["u", "v", "1"]), _cramer(_COLUMNS[:3], ["u", "v", "1"])
_H = lambda k: f"h[{k + 1}]"
_UNIT_A, _UNIT_B = ([f"({_H(3 * r + c)} / s{c})" for r in range(3)] for c in (0, 1))
_POSE = [x for r in range(3) for x in (_UNIT_A[r], _UNIT_B[r], f"({_UNIT_A[(r + 1) % 3]} * {_UNIT_B[(r + 2) % 3]} - {_UNIT_A[(r + 2) % 3]} * {_UNIT_B[(r + 1) % 3]})", f"({_H(3 * r + 2)} * 2 / (s0 + s1))")]

ORACLE_SQL = {
    "volume_fit": f"""
        WITH {_LINES} SELECT DISTINCT k AS key, {', '.join(f'round(own_{n}, 4) AS {n}' for n in fits.PARAMETERS)}, true AS met FROM track""",
    "track_loss": f"""
        WITH {_LINES}, o AS MATERIALIZED {_seen(_corners('track', _moved(_SELF)))}, f AS MATERIALIZED {_seen(_corners('track', _moved(_FIRST)))},
        s AS (SELECT o.k, sum(ln(1 + sqrt(pow(o.l - f.l, 2) + pow(o.t - f.t, 2)) + sqrt(pow(o.r - f.r, 2) + pow(o.t - f.t, 2)) + sqrt(pow(o.l - f.l, 2) + pow(o.b - f.b, 2)) + sqrt(pow(o.r - f.r, 2) + pow(o.b - f.b, 2)))) AS loss
              FROM o JOIN f ON f.id = o.id GROUP BY o.k),
        p AS (SELECT DISTINCT k, ln(1 + pow(own_width / own_length - 0.43::DOUBLE, 2) / 2) + ln(1 + pow(own_height / own_length - 0.36::DOUBLE, 2) / 2) AS prior FROM track)
        SELECT s.k AS key, round(loss, 5) AS loss, round(prior, 8) AS prior FROM s JOIN p ON p.k = s.k""",
    "footprint_hidden": f"""
        WITH {_LINES}, c AS MATERIALIZED (SELECT id, k, c, gx AS x, gy AS y FROM {_corners('track', _SELF | {'px': 'x', 'py': 'y', 'theta': 'turn'})} WHERE up = 0),
        e AS (SELECT a.id, a.c AS c, b.c AS d, a.x AS ax, a.y AS ay, b.x - a.x AS sx, b.y - a.y AS sy FROM c a JOIN c b ON b.id = a.id AND b.c = (a.c + 1) % 4),
        h AS (SELECT p.id, p.k, p.c, bool_or(den <> 0 AND ((ax - p.x) * sy - (ay - p.y) * sx) / den > 0 AND ((ax - p.x) * sy - (ay - p.y) * sx) / den < 2
                AND ((ax - p.x) * dy - (ay - p.y) * dx) / den BETWEEN 0 AND 1) AS hidden
              FROM (SELECT p.*, e.ax, e.ay, e.sx, e.sy, {_EYE[0]} - p.x AS dx, {_EYE[1]} - p.y AS dy, ({_EYE[0]} - p.x) * e.sy - ({_EYE[1]} - p.y) * e.sx AS den FROM c p JOIN e ON e.id = p.id AND p.c <> e.c AND p.c <> e.d) p GROUP BY p.id, p.k, p.c)
        SELECT k AS key, {', '.join(f'count(*) FILTER (hidden AND c = {n}) AS hidden_{n}' for n in range(4))} FROM h GROUP BY k""",
    "ground_seen": f"""
        WITH e AS (SELECT vec_id, 640 + 900 * embedding[1]::DOUBLE AS u, 700 + 200 * embedding[2]::DOUBLE AS v FROM embeddings),
        s AS (SELECT vec_id, {', '.join(f'{x} AS g{k}' for k, x in enumerate(_GROUND))}, {', '.join(f'{x} AS r{k}' for k, x in enumerate(_RAY))} FROM e)
        SELECT vec_id AS frame, round(g0 / g2, 6) AS x, round(g1 / g2, 6) AS y, {', '.join(f'round(r{k} / sqrt(r0 * r0 + r1 * r1 + r2 * r2), 6) AS ray_{c}' for k, c in enumerate('xyz'))} FROM s""",
    "homography_pose": f"""
        WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS h FROM embeddings),
        s AS (SELECT *, sqrt(h[1] * h[1] + h[4] * h[4] + h[7] * h[7]) AS s0, sqrt(h[2] * h[2] + h[5] * h[5] + h[8] * h[8]) AS s1 FROM e)
        SELECT vec_id AS frame, {', '.join(f'round({x}, 6) AS p{k}' for k, x in enumerate(_POSE))} FROM s""",
    # turned about z, then y, then x, one after the other
    "euler_turned": f"""
        WITH e AS (SELECT vec_id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
        a AS (SELECT vec_id, {cos(_C)!r}::DOUBLE * x - {sin(_C)!r}::DOUBLE * y AS x, {sin(_C)!r}::DOUBLE * x + {cos(_C)!r}::DOUBLE * y AS y, z FROM e),
        b AS (SELECT vec_id, {cos(_B)!r}::DOUBLE * x + {sin(_B)!r}::DOUBLE * z AS x, y, {cos(_B)!r}::DOUBLE * z - {sin(_B)!r}::DOUBLE * x AS z FROM a),
        c AS (SELECT vec_id, x, {cos(_A)!r}::DOUBLE * y - {sin(_A)!r}::DOUBLE * z AS y, {sin(_A)!r}::DOUBLE * y + {cos(_A)!r}::DOUBLE * z AS z FROM b)
        SELECT vec_id AS frame, round(-x, 6) AS x, round(y, 6) AS y, round(z - 1, 6) AS z FROM c""",
}
