"""Aggregates, set operations and validation."""

from __future__ import annotations

from functools import reduce
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.session import ranked


def median_frame(frames: DataFrame) -> DataFrame:
    """(group, k, value): the exact median of every component over a group's frames."""
    return frames.select("group", F.posexplode("pixels").alias("k", "x")).groupBy("group", "k").agg(F.median(F.col("x").cast("double")).alias("value"))


def vote(scores: DataFrame, least: float = 0.5, share: float = 0.05) -> DataFrame:
    """(group, share): groups of which at least ``share`` of the scores reach ``least``."""
    return scores.groupBy("group").agg(F.avg((F.col("score") >= least).cast("double")).alias("share")).where(F.col("share") >= share)


def density(points: DataFrame, x0: float, y0: float, x1: float, y1: float, width: int, height: int, value: Column | None = None) -> DataFrame:
    """(bin_x, bin_y, value): points, or their values, summed over a grid; bins truncate and points outside are dropped."""
    bx = F.floor((F.col("x") - x0) / (x1 - x0) * width).cast("int")
    by = F.floor((F.col("y") - y0) / (y1 - y0) * height).cast("int")
    inside = F.col("bin_x").between(0, width - 1) & F.col("bin_y").between(0, height - 1)
    return points.select(bx.alias("bin_x"), by.alias("bin_y"), (value if value is not None else F.lit(1)).alias("v")).where(inside).groupBy("bin_x", "bin_y").agg(F.sum("v").alias("value"))


def neighbours_within(points: DataFrame, radius: float) -> DataFrame:
    """(id, n): other points within the radius, by a grid of its width: a point meets only the nine cells about it."""
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    own = points.select("id", "x", "y", cell("x").alias("cx"), cell("y").alias("cy"))
    other = own.select(F.col("id").alias("id2"), F.col("x").alias("x2"), F.col("y").alias("y2"), "cx", "cy", F.explode(around).alias("o"))
    other = other.select("id2", "x2", "y2", (F.col("cx") + F.col("o.a")).alias("cx"), (F.col("cy") + F.col("o.b")).alias("cy"))
    near = own.join(other, ["cx", "cy"]).where((F.col("id") != F.col("id2")) & (F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2")) <= radius))
    counts = near.groupBy("id").agg(F.count("*").alias("n"))
    return points.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))


def density_radius(width: float, height: float) -> float:
    return (width * height / (100 * pi)) ** 0.5


def first_of_equal(rows: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The first row, by ``order``, of every run of equal columns."""
    rank = F.row_number().over(W.partitionBy(*columns).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def dense_ids(rows: DataFrame, value: str, order: str) -> DataFrame:
    """(value, id): ids from 0 in the order of first appearance."""
    firsts = rows.groupBy(value).agg(F.min(order).alias("first"))
    return ranked(firsts, "first", "id").select(value, F.col("id").cast("int").alias("id"))


def robust_loss(column: str) -> Column:
    return F.sum(F.log1p(column))


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of just one of two tables with the same columns."""
    return a.exceptAll(b).distinct().join(b, a.columns, "left_anti").union(b.distinct().join(a, a.columns, "left_anti"))


def blob_relation(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old, new, kind) from (pixel, blob) rows of two frames: same, merge (n:1), split (1:n), mixed, birth and death."""
    pairs = old.select("pixel", F.col("blob").alias("old")).join(new.select("pixel", F.col("blob").alias("new")), "pixel").select("old", "new").distinct()
    counted = pairs.groupBy("new").agg(F.count("*").alias("olds"))
    split = pairs.groupBy("old").agg(F.count("*").alias("news"))
    kind = F.when((F.col("olds") > 1) & (F.col("news") > 1), "mixed").when(F.col("olds") > 1, "merge").when(F.col("news") > 1, "split").otherwise("same")
    kept = pairs.join(counted, "new").join(split, "old").select("old", "new", kind.alias("kind"))
    born = new.select(F.col("blob").alias("new")).distinct().join(pairs, "new", "left_anti").select(F.lit(None).cast(dict(pairs.dtypes)["old"]).alias("old"), "new", F.lit("birth").alias("kind"))
    dead = old.select(F.col("blob").alias("old")).distinct().join(pairs, "old", "left_anti").select("old", F.lit(None).cast(dict(pairs.dtypes)["new"]).alias("new"), F.lit("death").alias("kind"))
    return kept.union(born).union(dead)


#: Codes of the catalog check, in the order in which they are tried.
CHECKS = (
    (1, "distance_rows IS NULL"),
    (11, "distance_rows <> frames"),
    (2, "transition_rows IS NULL"),
    (21, "transition_rows <> frames"),
    (31, "has_masks AND patches IS NULL"),
    (3, "has_masks AND coalesce(first_missing_box < frames - 1 AND first_missing_box <= coalesce(first_missing_patch, frames), false)"),
    (32, "has_masks AND coalesce(first_missing_patch < frames - 1, false)"),
    (4, "semantic_rows IS NULL"),
    (41, "semantic_rows <> frames"),
)


def validate(catalog: DataFrame) -> DataFrame:
    """The catalog with code: that of the first check that fails, else 0. Missing boxes and patches of the last frame pass.

    ``first_missing_box`` and ``first_missing_patch`` are the positions of the first frames without one, null if none.
    """
    code = reduce(lambda rest, check: F.when(F.expr(check[1]), check[0]).otherwise(rest), reversed(CHECKS), F.lit(0))
    return catalog.withColumn("code", code)


def interval_totals(log: DataFrame) -> DataFrame:
    """(key, action, seconds): time from each event to the key's next, summed by action; the last event is open."""
    log = log.withColumn("ts", F.col("ts").cast("timestamp_ltz"))
    ahead = F.lead("ts").over(W.partitionBy("key").orderBy("ts", "id"))
    spent = (F.unix_micros(ahead) - F.unix_micros("ts")) / 1e6
    return log.select("key", "action", spent.alias("seconds")).where("seconds IS NOT NULL").groupBy("key", "action").agg(F.sum("seconds").alias("seconds"))
