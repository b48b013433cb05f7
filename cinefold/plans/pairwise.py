"""Queries over pairs of frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import distance
from cinefold.session import table


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame"), F.col("embedding").alias("pixels"), "label")


def knn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest other frames of every frame."""
    rows = frames(spark, sf_dir)
    return distance.nearest(rows, rows, k=3, skip_self=True).withColumn("d2", F.round("d2", 6))


def pair_ssd(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.squared(rows, rows).withColumn("d2", F.round("d2", 6))


def pair_euclid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.squared(rows, rows).select("i", "j", F.round(F.sqrt("d2"), 6).alias("distance"))


def cross_ssd_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared distances of every frame to every label's mean frame."""
    rows = frames(spark, sf_dir)
    means = (
        rows.select("label", F.posexplode(F.col("pixels").cast("array<double>")).alias("k", "x")).groupBy("label", "k").agg(F.avg("x").alias("x"))
        .groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("pixels"))
        .select(F.col("label").cast("long").alias("frame"), "pixels")
    )
    return distance.squared(rows, means).select(F.col("i").alias("frame"), F.col("j").alias("label"), F.round("d2", 6).alias("d2"))


def mutual_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.mutual(distance.nearest(rows, rows, k=1, skip_self=True))


def ratio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.ratio_match(distance.nearest(rows, rows, k=2, skip_self=True), ratio=0.95).withColumn("angle", F.round("angle", 5))


def idw_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels interpolated from the four nearest other frames."""
    rows = frames(spark, sf_dir)
    found = distance.inverse_distance(distance.nearest(rows, rows, k=4, skip_self=True), rows.select("frame", F.col("label").cast("double").alias("value")))
    return found.withColumn("value", F.round("value", 5))


def threshold_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames(spark, sf_dir)
    return distance.last_near(rows, rows, 1.2)


def overlap_norm_dist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance distances of suppliers that share a part, by the overlap of their parts."""
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    found = distance.overlap_normalised(
        lines.select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("member")), suppliers.select(F.col("s_suppkey").alias("set"), F.col("s_acctbal").alias("value")))
    return found.withColumn("distance", F.round("distance", 4))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as one series a user: (key, t, value), t the rank by time."""
    from pyspark.sql import Window as W

    t = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), t.alias("t"), "value", "ts", "event_type", "event_id")


def shifted_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = series(spark, sf_dir).select("key", "t", "value")
    return distance.shifted(rows, rows, 3, F.round(F.abs(F.col("a.value") - F.col("b.value")), 6))


def early_out_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each value is over 100, until a series' first that isn't."""
    rows = series(spark, sf_dir).select("key", "t", F.round(F.greatest(F.col("value") - 100, F.lit(0.0)), 6).alias("distance"))
    return distance.early_out(rows)


QUERIES = {
    f.__name__: f
    for f in (knn_frames, pair_ssd, pair_euclid, cross_ssd_by_label, mutual_nn, ratio_match, idw_interp, threshold_pick, overlap_norm_dist, shifted_distance, early_out_distance)
}

_D2 = "list_sum(list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
PAIRS = f"p AS (SELECT a.vec_id AS i, b.vec_id AS j, {_D2} AS d2 FROM embeddings a, embeddings b)"
NEAR = f"{PAIRS}, r AS (SELECT i AS frame, j AS neighbour, d2, row_number() OVER (PARTITION BY i ORDER BY d2, j) AS rank FROM p WHERE i <> j)"
SERIES = "s AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value, ts, event_type, event_id FROM events)"

ORACLE_SQL = {
    "knn_frames": f"WITH {NEAR} SELECT frame, neighbour, rank::INTEGER AS rank, round(d2, 6) AS d2 FROM r WHERE rank <= 3",
    "pair_ssd": f"WITH {PAIRS} SELECT i, j, round(d2, 6) AS d2 FROM p",
    "pair_euclid": f"WITH {PAIRS} SELECT i, j, round(sqrt(d2), 6) AS distance FROM p",
    "cross_ssd_by_label": """
        WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings),
        m AS (SELECT label, k, avg(x) AS m FROM e GROUP BY label, k)
        SELECT e.vec_id AS frame, m.label::BIGINT AS label, round(sum((x - m) * (x - m)), 6) AS d2 FROM e JOIN m ON e.k = m.k GROUP BY e.vec_id, m.label""",
    "mutual_nn": f"WITH {NEAR} SELECT a.frame, a.neighbour FROM r a JOIN r b ON a.frame = b.neighbour AND a.neighbour = b.frame WHERE a.rank = 1 AND b.rank = 1",
    "ratio_match": f"""
        WITH {NEAR}, g AS (SELECT frame, rank, neighbour, acos(0.9999 * (1 - d2 / 2)) AS angle FROM r WHERE rank <= 2)
        SELECT a.frame, CASE WHEN a.angle < 0.95 * b.angle THEN a.neighbour END AS match, round(a.angle, 5) AS angle
        FROM g a LEFT JOIN g b ON a.frame = b.frame AND b.rank = 2 WHERE a.rank = 1""",
    "idw_interp": f"""
        WITH {NEAR} SELECT frame, round(coalesce(avg(CASE WHEN d2 = 0 THEN label END),
            sum(CASE WHEN d2 > 0 THEN label / pow(d2, 3) END) / sum(CASE WHEN d2 > 0 THEN 1 / pow(d2, 3) END)), 5) AS value
        FROM r JOIN embeddings e ON e.vec_id = r.neighbour WHERE rank <= 4 GROUP BY frame""",
    "threshold_pick": f"""
        WITH {PAIRS} SELECT e.vec_id AS frame, coalesce(max(p.j), -1) AS pick FROM embeddings e
        LEFT JOIN p ON p.i = e.vec_id AND p.i <> p.j AND sqrt(p.d2) < 1.2 GROUP BY e.vec_id""",
    "overlap_norm_dist": """
        WITH own AS (SELECT DISTINCT l_suppkey AS s, l_partkey AS m FROM lineitem),
        f AS (SELECT s, count(*) AS n, any_value(s_acctbal) AS value FROM own JOIN supplier ON s_suppkey = s GROUP BY s),
        c AS (SELECT a.s AS a, b.s AS b, count(*) AS c FROM own a JOIN own b ON a.m = b.m AND a.s < b.s GROUP BY a.s, b.s)
        SELECT c.a, c.b, round(abs(x.value - y.value) / (2 * c.c / (x.n + y.n + 0.01::DOUBLE) + 0.01::DOUBLE), 4) AS distance
        FROM c JOIN f x ON x.s = c.a JOIN f y ON y.s = c.b""",
    "shifted_distance": f"WITH {SERIES} SELECT b.key, b.t::INTEGER AS t, round(abs(a.value - b.value), 6) AS distance FROM s a JOIN s b ON a.key = b.key AND a.t - 3 = b.t",
    "early_out_distance": f"""
        WITH {SERIES}, d AS (SELECT key, t, round(greatest(value - 100, 0.0::DOUBLE), 6) AS distance FROM s)
        SELECT key, t::INTEGER AS t, CASE WHEN bool_or(distance = 0) OVER (PARTITION BY key ORDER BY t) THEN 0.0 ELSE distance END AS distance FROM d""",
}
