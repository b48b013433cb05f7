"""Queries over aggregates, sets, tracks and geometry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.functions import curves, geometry
from cinefold.operators import aggregate, cost, tracks
from cinefold.plans.pairwise import SERIES, frames, series
from cinefold.session import table


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames as plane points: the first two components, at six digits."""
    part = lambda k: F.round(F.col("pixels")[k].cast("double"), 6)
    return frames(spark, sf_dir).select(F.col("frame").alias("id"), part(0).alias("x"), part(1).alias("y"), "label")


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track a user: boxes by value and rank."""
    rows = series(spark, sf_dir)
    return rows.select(F.col("key").alias("object"), F.col("t").cast("long").alias("frame"), F.col("value").alias("x"), (F.col("t") * 3.0).alias("y"), F.lit(20.0).alias("w"), (10.0 + F.col("t")).alias("h"))


def median_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.median_frame(frames(spark, sf_dir).select(F.col("label").alias("group"), "pixels")).withColumn("value", F.round("value", 6))


def percentile_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines at or under the order statistic at a tenth of the prices, and how many."""
    lines = table(spark, sf_dir, "lineitem").select("l_extendedprice")
    limit = cost.order_statistic(lines, "l_extendedprice", 0.1)
    return lines.where(F.col("l_extendedprice") <= limit).agg(F.count("*").alias("n"), F.max("l_extendedprice").alias("threshold"))


def vote_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = table(spark, sf_dir, "events").select(F.col("user_id").alias("group"), (F.col("value") / 200).alias("score"))
    return aggregate.vote(scores, 0.25, 0.4).withColumn("share", F.round("share", 6))


def density_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.density(_points(spark, sf_dir), -0.5, -0.5, 0.5, 0.5, 20, 20)


def density_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.density(_points(spark, sf_dir), -0.5, -0.5, 0.5, 0.5, 20, 20, F.col("label"))


def neighbour_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.neighbours_within(_points(spark, sf_dir), 0.05)


def bounding_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _points(spark, sf_dir).groupBy("label")
    return found.agg(*[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("min", F.min), ("max", F.max))])


def frame_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("spread"),
        F.count_if(F.col("value") > 100).alias("over"), F.round(aggregate.robust_loss("value"), 5).alias("loss"))


def row_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return aggregate.first_of_equal(rows, ["user_id", "event_type"], "event_id")


def vertex_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types as vertices, numbered by first appearance."""
    return aggregate.dense_ids(table(spark, sf_dir, "part"), "p_type", "p_partkey")


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_returnflag = 'R' AND l_quantity < 10").select("l_partkey"), lines.where("l_returnflag = 'A' AND l_quantity > 40").select("l_partkey")


def set_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.distinct().join(b, "l_partkey", "left_anti")


def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.distinct().join(b, "l_partkey", "left_semi")


def set_symdiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.symmetric_difference(*_sets(spark, sf_dir))


def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _sets(spark, sf_dir)
    return a.unionByName(b).groupBy("l_partkey").agg(F.count("*").alias("n"))


def blob_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pixels: their last supplier among returned lines is the old blob, among accepted ones the new."""
    lines = table(spark, sf_dir, "lineitem")
    of = lambda flag: lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("pixel")).agg(F.max("l_suppkey").alias("blob"))
    return aggregate.blob_relation(of("R"), of("A"))


def catalog_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence a customer, with faults by key."""
    k = F.col("c_custkey")
    facts = table(spark, sf_dir, "customer").select(
        k.alias("sequence"), F.lit(10).alias("frames"), F.when(k % 11 != 0, F.when(k % 13 == 0, 9).otherwise(10)).alias("distance_rows"), F.when(k % 7 != 0, F.when(k % 17 == 0, 9).otherwise(10)).alias("transition_rows"),
        (k % 2 == 0).alias("has_masks"), F.when(k % 5 != 0, 10).alias("patches"), F.when(k % 3 == 0, (k % 10).cast("int")).alias("first_missing_box"), F.when(k % 19 == 0, 4).alias("first_missing_patch"),
        F.when(k % 23 != 0, F.when(k % 29 == 0, 9).otherwise(10)).alias("semantic_rows"))
    return aggregate.validate(facts).select("sequence", "code")


def interval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("action"), "ts", F.col("event_id").alias("id"))
    return aggregate.interval_totals(log).withColumn("seconds", F.round("seconds", 3))


def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = _track(spark, sf_dir).where(tracks.inside_edges(500, 400, 3))
    return tracks.motion(tracks.corners(kept).select("object", "frame", "mx", "my", (F.col("w") * F.col("h")).alias("area")), 120.0)


def track_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracks.admitted(_moved(spark, sf_dir), 60, 90).withColumn("mean", F.round("mean", 5))


def first_jump_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _moved(spark, sf_dir).where("later IS NOT NULL").select("object", "frame", "later", F.round("ratio", 6).alias("ratio"))


def box_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of each frame's point to the box [-0.05, 0.05] x [-0.02, 0.08]."""
    d = geometry.point_box_distance(F.col("x"), F.col("y"), *map(F.lit, (-0.05, -0.02, 0.05, 0.08)))
    return _points(spark, sf_dir).select("id", F.round(d, 6).alias("distance"))


def polygon_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area of each label's points taken in the order of their frames."""
    shapes = _points(spark, sf_dir).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("points"))
    return shapes.select("label", F.round(geometry.polygon_area(F.col("points")), 6).alias("area"))


def ground_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = geometry.homography([[1.0, 0.2, 0.1], [0.0, 1.5, -0.3], [0.1, 0.05, 1.0]], F.col("x"), F.col("y"))
    return _points(spark, sf_dir).select("id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


def neg_log_gauss(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost_ = curves.minus_log_gaussian([F.col("x"), F.col("y")], [0.1, -0.1], [[0.5, 0.1], [0.1, 0.25]])
    return _points(spark, sf_dir).select("id", F.round(cost_, 6).alias("cost"))


def smoothstep_ramp(spark: SparkSession, sf_dir: str) -> DataFrame:
    ramp = table(spark, sf_dir, "region").select("r_regionkey", F.posexplode(curves.smoothstep(8)).alias("step", "value"))
    return ramp.withColumn("value", F.round("value", 6))


def angle_to_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees between each frame's point, on the circle, and the first axis."""
    norm = F.hypot("x", "y")
    return _points(spark, sf_dir).where("x <> 0 OR y <> 0").select("id", F.round(geometry.angle_between((F.col("x") / norm, F.col("y") / norm), (F.lit(1.0), F.lit(0.0))), 4).alias("degrees"))


QUERIES = {
    f.__name__: f
    for f in (
        median_vector, percentile_cut, vote_share, density_bins, density_weighted, neighbour_density, bounding_range, frame_moments, row_dedup, vertex_ids, set_except, set_intersect, set_symdiff, set_union,
        blob_relation, catalog_validate, interval_totals, track_admission, first_jump_pairs, box_distance, polygon_area, ground_plane, neg_log_gauss, smoothstep_ramp, angle_to_view,
    )
}

_P = "p AS (SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS x, round(embedding[2]::DOUBLE, 6) AS y, label FROM embeddings)"
_BIN = f"WITH {_P}, b AS (SELECT floor((x + 0.5::DOUBLE) / 1.0::DOUBLE * 20)::INTEGER AS bin_x, floor((y + 0.5::DOUBLE) / 1.0::DOUBLE * 20)::INTEGER AS bin_y, label FROM p)"
_TRACK = f"""WITH {SERIES}, k AS (SELECT key AS object, t AS frame, value + 10 AS mx, t * 3.0 + 10.0 + t AS my, 20.0 * (10.0 + t) AS area FROM s
    WHERE abs(value) >= 3 AND abs(t * 3.0) >= 3 AND abs(value + 20 - 500) >= 3 AND abs(t * 3.0 + 10.0 + t - 400) >= 3),
    d AS (SELECT a.object, a.frame, b.frame AS later, b.area / a.area AS ratio, sqrt((a.mx - b.mx) * (a.mx - b.mx) + (a.my - b.my) * (a.my - b.my)) AS away FROM k a JOIN k b ON a.object = b.object AND a.frame < b.frame)"""
_A, _B = "(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10)", "(SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 40)"
_INV = "1 / 0.115::DOUBLE"

ORACLE_SQL = {
    "median_vector": "WITH e AS (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT label AS \"group\", k::INTEGER AS k, round(median(x), 6) AS value FROM e GROUP BY label, k",
    "percentile_cut": """
        WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) AS rank FROM lineitem),
        l AS (SELECT v AS lim FROM r WHERE rank = floor((SELECT count(*) FROM lineitem) * 0.1::DOUBLE) + 1)
        SELECT count(*) AS n, max(v) AS threshold FROM r, l WHERE v <= lim""",
    "vote_share": "SELECT user_id AS \"group\", round(avg((value / 200 >= 0.25)::INTEGER), 6) AS share FROM events GROUP BY user_id HAVING avg((value / 200 >= 0.25)::INTEGER) >= 0.4",
    "density_bins": f"{_BIN} SELECT bin_x, bin_y, count(*) AS value FROM b WHERE bin_x BETWEEN 0 AND 19 AND bin_y BETWEEN 0 AND 19 GROUP BY bin_x, bin_y",
    "density_weighted": f"{_BIN} SELECT bin_x, bin_y, sum(label)::BIGINT AS value FROM b WHERE bin_x BETWEEN 0 AND 19 AND bin_y BETWEEN 0 AND 19 GROUP BY bin_x, bin_y",
    "neighbour_density": f"WITH {_P} SELECT a.id, count(b.id) AS n FROM p a LEFT JOIN p b ON a.id <> b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.05 GROUP BY a.id",
    "bounding_range": f"WITH {_P} SELECT label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM p GROUP BY label",
    "frame_moments": """
        SELECT event_type, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, count(*) FILTER (value > 100) AS over, round(sum(ln(1 + value)), 5) AS loss
        FROM events GROUP BY event_type""",
    "row_dedup": "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
    "vertex_ids": "WITH f AS (SELECT p_type, min(p_partkey) AS first FROM part GROUP BY p_type) SELECT p_type, (row_number() OVER (ORDER BY first) - 1)::INTEGER AS id FROM f",
    "set_except": f"SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}",
    "set_intersect": f"SELECT * FROM {_A} INTERSECT SELECT * FROM {_B}",
    "set_symdiff": f"(SELECT * FROM {_A} EXCEPT SELECT * FROM {_B}) UNION ALL (SELECT * FROM {_B} EXCEPT SELECT * FROM {_A})",
    "set_union": "SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' AND l_quantity < 10 OR l_returnflag = 'A' AND l_quantity > 40 GROUP BY l_partkey",
    "blob_relation": """
        WITH o AS (SELECT l_partkey AS p, max(l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), n AS (SELECT l_partkey AS p, max(l_suppkey) AS b FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1),
        x AS (SELECT DISTINCT o.b AS old, n.b AS new FROM o JOIN n ON o.p = n.p),
        c AS (SELECT old, new, count(*) OVER (PARTITION BY new) AS olds, count(*) OVER (PARTITION BY old) AS news FROM x)
        SELECT old, new, CASE WHEN olds > 1 AND news > 1 THEN 'mixed' WHEN olds > 1 THEN 'merge' WHEN news > 1 THEN 'split' ELSE 'same' END AS kind FROM c
        UNION ALL SELECT NULL, b, 'birth' FROM (SELECT DISTINCT b FROM n WHERE b NOT IN (SELECT new FROM x))
        UNION ALL SELECT b, NULL, 'death' FROM (SELECT DISTINCT b FROM o WHERE b NOT IN (SELECT old FROM x))""",
    "catalog_validate": """
        SELECT c_custkey AS sequence, CASE WHEN c_custkey % 11 = 0 THEN 1 WHEN c_custkey % 13 = 0 THEN 11 WHEN c_custkey % 7 = 0 THEN 2 WHEN c_custkey % 17 = 0 THEN 21
            WHEN c_custkey % 2 = 0 AND c_custkey % 5 = 0 THEN 31
            WHEN c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 10 < 9 AND c_custkey % 10 <= CASE WHEN c_custkey % 19 = 0 THEN 4 ELSE 10 END THEN 3
            WHEN c_custkey % 2 = 0 AND c_custkey % 19 = 0 THEN 32 WHEN c_custkey % 23 = 0 THEN 4 WHEN c_custkey % 29 = 0 THEN 41 ELSE 0 END AS code FROM customer""",
    "interval_totals": """
        WITH l AS (SELECT user_id AS key, event_type AS action, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts) AS us FROM events)
        SELECT key, action, round(sum(us / 1e6), 3) AS seconds FROM l WHERE us IS NOT NULL GROUP BY key, action""",
    "track_admission": f"""
        {_TRACK}, n AS (SELECT object, count(*) AS n FROM k GROUP BY object), m AS (SELECT object, avg(away) AS mean FROM d GROUP BY object)
        SELECT n.object, n.n, round(m.mean, 5) AS mean FROM n JOIN m ON n.object = m.object WHERE n.n >= 60 AND m.mean >= 90""",
    "first_jump_pairs": f"{_TRACK} SELECT object, frame, min(later) AS later, round(arg_min(ratio, later), 6) AS ratio FROM d WHERE away > 120 GROUP BY object, frame",
    "box_distance": f"""
        WITH {_P}, d AS (SELECT id, greatest(-0.05::DOUBLE - x, 0::DOUBLE, x - 0.05::DOUBLE) AS dx, greatest(-0.02::DOUBLE - y, 0::DOUBLE, y - 0.08::DOUBLE) AS dy FROM p) SELECT id, round(sqrt(dx * dx + dy * dy), 6) AS distance FROM d""",
    "polygon_area": f"""
        WITH {_P}, r AS (SELECT label, x, y, row_number() OVER (PARTITION BY label ORDER BY id) AS k, count(*) OVER (PARTITION BY label) AS n FROM p)
        SELECT a.label, round(abs(sum(a.x * b.y - a.y * b.x)) / 2, 6) AS area FROM r a JOIN r b ON a.label = b.label AND b.k = a.k % a.n + 1 GROUP BY a.label""",
    "ground_plane": f"""
        WITH {_P} SELECT id, round((1.0::DOUBLE * x + 0.2::DOUBLE * y + 0.1::DOUBLE) / (0.1::DOUBLE * x + 0.05::DOUBLE * y + 1.0::DOUBLE), 6) AS x,
            round((0.0::DOUBLE * x + 1.5::DOUBLE * y - 0.3::DOUBLE) / (0.1::DOUBLE * x + 0.05::DOUBLE * y + 1.0::DOUBLE), 6) AS y FROM p""",
    "neg_log_gauss": f"""
        WITH {_P}, g AS (SELECT id, x - 0.1::DOUBLE AS a, y + 0.1::DOUBLE AS b FROM p)
        SELECT id, round(0.5::DOUBLE * (2 * ln(2 * pi()) + ln(0.115::DOUBLE)) + 0.5::DOUBLE * (0.25::DOUBLE * a * a - 0.2::DOUBLE * a * b + 0.5::DOUBLE * b * b) * {_INV}, 6) AS cost FROM g""",
    "smoothstep_ramp": """
        WITH s AS (SELECT r_regionkey, unnest(range(1, 9)) AS i FROM region)
        SELECT r_regionkey, (i - 1)::INTEGER AS step, round(6 * pow(i / 9::DOUBLE, 5) - 15 * pow(i / 9::DOUBLE, 4) + 10 * pow(i / 9::DOUBLE, 3), 6) AS value FROM s""",
    "angle_to_view": f"WITH {_P} SELECT id, round(degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x / sqrt(x * x + y * y))))), 4) AS degrees FROM p WHERE x <> 0 OR y <> 0",
}
