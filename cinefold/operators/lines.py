"""Lines peeled off point sets by random sample consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.session import settled

#: Hypotheses a line, and the seed of their points.
TRIALS, SEED = 100, 42


def _order(number: int, seed: int):
    """Where a point stands in the round's draw."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(number)), F.col("id").cast("string")))


def peel(points: DataFrame, lines: int = 5, trials: int = TRIALS, threshold: float | None = None, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(found, left): up to ``lines`` lines (key, line, inliers, slope, intercept) of every key's (key, id, x, y), and the
    points (key, id, line) with the line that took them, null if none did.

    A round draws pairs of a key's points that are left, in the order of a seeded digest, two hypotheses never sharing a
    point; all are scored in one pass, and the one with the most points within ``threshold`` of it in y wins, the first
    of equal ones. Without a threshold it is the median of the points' distances from their median y. The line is fitted
    to its points by least squares, and they are peeled off. Pairs with equal x are no hypotheses; keys without any, and
    points with a null coordinate, give none. Counts are combined before they are shuffled; a task holds the hypotheses
    of a key and no key's points.
    """
    left = settled(points.where("x IS NOT NULL AND y IS NOT NULL").select("key", "id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    taken, found = [], []
    for number in range(lines):
        order = _order(number, seed)
        place = F.row_number().over(W.partitionBy("key").orderBy(order, "id")) - 1
        drawn = left.withColumn("place", place).where(F.col("place") < 2 * trials)
        pairs = drawn.groupBy("key", F.floor(F.col("place") / 2).alias("trial")).agg(
            *[F.max(F.when(F.col("place") % 2 == side, F.col(c))).alias(f"{c}{side}") for c in "xy" for side in (0, 1)])
        pairs = pairs.where("x0 <> x1").withColumn("slope", (F.col("y1") - F.col("y0")) / (F.col("x1") - F.col("x0")))
        tried = settled(pairs.select("key", "trial", "slope", (F.col("y0") - F.col("slope") * F.col("x0")).alias("intercept")))
        limits = left.select("key").distinct().withColumn("limit", F.lit(threshold)) if threshold is not None else _spread(left)
        listed = tried.groupBy("key").agg(F.collect_list(F.struct("trial", "slope", "intercept")).alias("tried")).join(limits, "key")
        near = left.join(listed, "key").select("key", F.explode(F.filter("tried", lambda h: F.abs(F.col("y") - h["slope"] * F.col("x") - h["intercept"]) <= F.col("limit"))).alias("h"))
        votes = near.groupBy("key", "h.trial").agg(F.count("*").alias("votes"))
        best = votes.groupBy("key").agg(F.max_by("trial", F.struct("votes", -F.col("trial"))).alias("trial"))
        best = settled(tried.join(best, ["key", "trial"]).join(limits, "key").select("key", "slope", "intercept", "limit"))
        marked = left.join(best, "key", "left").withColumn("hit", F.coalesce(F.abs(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept")) <= F.col("limit"), F.lit(False)))
        marked = settled(marked.select("key", "id", "x", "y", "hit"))
        own = marked.where("hit")
        found.append(own.groupBy("key").agg(F.lit(number).alias("line"), F.count("*").alias("inliers"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept")))
        taken.append(own.select("key", "id", F.lit(number).alias("line")))
        left = marked.where("NOT hit").select("key", "id", "x", "y")
        if own.isEmpty():
            break
    rest = left.select("key", "id", F.lit(None).cast("int").alias("line"))
    for part in taken:
        rest = rest.union(part)
    lines_found = found[0]
    for part in found[1:]:
        lines_found = lines_found.union(part)
    return lines_found, rest


def _spread(points: DataFrame) -> DataFrame:
    """(key, limit): the median distance of y from its median."""
    middle = points.groupBy("key").agg(F.median("y").alias("middle"))
    return points.join(middle, "key").groupBy("key").agg(F.median(F.abs(F.col("y") - F.col("middle"))).alias("limit"))
