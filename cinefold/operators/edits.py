"""Edits of a sequence's boxes, rows (key, frame, x, y, angle, path), and masks and clusters over points."""

from __future__ import annotations

from math import exp, pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.operators.distance import linked
from cinefold.operators.graph import components

_BOX = ("key", "frame", "x", "y", "angle", "path")


def upserted(boxes: DataFrame, ranges: DataFrame) -> DataFrame:
    """The boxes with those of (key, first, last, x, y, angle, path, n) rows at every frame from first to last.

    A frame that is there is overwritten; of several ranges over a frame the one with the highest n holds.
    """
    each = ranges.withColumn("frame", F.explode(F.sequence("first", "last")))
    new = each.groupBy("key", "frame").agg(F.max_by(F.struct("x", "y", "angle", "path"), "n").alias("b")).select("key", "frame", "b.*")
    return boxes.select(*_BOX).join(new, ["key", "frame"], "left_anti").unionByName(new)


def ended(boxes: DataFrame) -> DataFrame:
    """The boxes and, after each key's last frame, an end marker: no box and an empty path."""
    last = boxes.groupBy("key").agg((F.max("frame") + 1).alias("frame")).withColumn("path", F.lit(""))
    return boxes.select(*_BOX).unionByName(last, allowMissingColumns=True)


def removed(boxes: DataFrame, gone: DataFrame) -> DataFrame:
    """The boxes without the (key, frame) rows of ``gone``: box, rotation and path together."""
    return boxes.join(gone.select("key", "frame"), ["key", "frame"], "left_anti")


def image_angle(dx: Column, dy: Column) -> Column:
    """The direction's angle on an image, whose y runs down, in [0, 2 pi)."""
    return F.pmod(F.atan2(-dy, dx), F.lit(2 * pi))


def turned_by(angle: Column, before: tuple[Column, Column], after: tuple[Column, Column]) -> Column:
    """The angle, turned by the signed angle between two directions; a direction without a length turns nothing."""
    size = F.hypot(*before) * F.hypot(*after)
    cosine = F.try_divide(before[0] * after[0] + before[1] * after[1], size)
    side = F.when(before[0] * after[1] - before[1] * after[0] < 0, -1.0).otherwise(1.0)
    return angle + F.coalesce(side * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))), F.lit(0.0))


def shared_scale(matrix: DataFrame) -> DataFrame:
    """(i, j, value) divided by the largest value, unless that is 0."""
    most = matrix.agg(F.max("value").alias("most"))
    scaled = F.when(F.col("most") == 0, F.col("value")).otherwise(F.col("value") / F.col("most"))
    return matrix.join(F.broadcast(most)).select("i", "j", scaled.alias("value"))


def near_samples(points: DataFrame, samples: list[tuple[float, float]]) -> DataFrame:
    """The (id, x, y) points no farther from the nearest of the samples than half of all points are."""
    away = F.array_min(F.array(*[F.hypot(F.col("x") - x, F.col("y") - y) for x, y in samples]))
    rows = points.withColumn("away", away)
    return rows.join(F.broadcast(rows.agg(F.median("away").alias("limit")))).where("away <= limit").drop("limit")


def blurred(bins: DataFrame, width: int, height: int, border: int, sigma: float) -> DataFrame:
    """(bin_x, bin_y, value) of counts on a grid, widened by a border, after a Gaussian filter that mirrors at the edges.

    The filter is separable: each bin goes to its neighbours in one direction, which are summed, then in the other.
    """
    reach = int(4 * sigma + 0.5)
    kernel = [exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    weights = F.array(*[F.struct(F.lit(k - reach).alias("k"), F.lit(w / sum(kernel)).alias("w")) for k, w in enumerate(kernel)])
    rows = bins.select((F.col("bin_x") + border).alias("bin_x"), (F.col("bin_y") + border).alias("bin_y"), F.col("value").cast("double").alias("value"))
    for c, n in (("bin_x", width + 2 * border), ("bin_y", height + 2 * border)):
        # A bin counts for a place as often as the mirrored grid repeats it within reach.
        images = F.array(*[image for turn in range(-(reach // n) - 1, reach // n + 2) for image in (F.col(c) + 2 * n * turn, 2 * n * turn - 1 - F.col(c))])
        spread = rows.withColumn("_at", F.explode(images)).where(F.col("_at").between(-reach, n - 1 + reach)).withColumn("_w", F.explode(weights))
        moved = spread.withColumn(c, (F.col("_at") + F.col("_w.k")).cast("int")).where(F.col(c).between(0, n - 1))
        rows = moved.groupBy("bin_x", "bin_y").agg(F.sum(F.col("value") * F.col("_w.w")).alias("value"))
    return rows


def single_link(frames: DataFrame, limit: float) -> DataFrame:
    """(frame, cluster): the smallest frame that steps of a squared distance of at most ``limit`` reach."""
    member = components(linked(frames, limit))
    return frames.select("frame").join(member.withColumnRenamed("node", "frame"), "frame", "left").select("frame", F.coalesce("component", "frame").alias("cluster"))
