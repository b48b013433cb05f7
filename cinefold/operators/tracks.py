"""Tracks: rows (object, frame, x, y, w, h)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.session import settled

#: Frames of a block of a track, and rows of distances that are held at a time.
_BLOCK, _ROWS = 2048, 256


def inside_edges(width: float, height: float, least: float) -> Column:
    """Whether a box is at least so far from all four edges; distances are absolute, so a box beyond one passes too."""
    gaps = (F.col("x"), F.col("y"), F.col("x") + F.col("w") - width, F.col("y") + F.col("h") - height)
    out = F.lit(True)
    for gap in gaps:
        out = out & (F.abs(gap) >= least)
    return out


def corners(track: DataFrame) -> DataFrame:
    """Boxes with x2, y2 and the middle of the lower edge (mx, my)."""
    return track.withColumns({"x2": F.col("x") + F.col("w"), "y2": F.col("y") + F.col("h"), "mx": F.col("x") + F.col("w") / 2, "my": F.col("y") + F.col("h")})


def motion(points: DataFrame, jump: float, block: int = _BLOCK) -> DataFrame:
    """(object, frame, later, ratio, n, mean): every point's first later one further away than ``jump``, if any.

    ``points`` has (object, frame, mx, my, area); ratio is the areas' quotient, n the track's length and mean its mean
    distance over all pairs. A track is cut into blocks of frames, one row each, and every two blocks of a track meet in
    a row of their own: no row holds more than two blocks, however long the track.
    """
    rows = points.select("object", F.floor(F.col("frame") / block).cast("long").alias("b"), F.struct(F.col("frame").cast("long").alias("frame"), *[F.col(c).cast("double").alias(c) for c in ("mx", "my", "area")]).alias("p"))
    blocks = settled(rows.groupBy("object", "b").agg(F.array_sort(F.collect_list("p")).alias("p")))
    later = blocks.select("object", F.col("b").alias("b2"), F.col("p").alias("q"))
    met = blocks.join(later, "object").where("b2 >= b").select("object", F.col("b") == F.col("b2"), *[F.col(f"{side}.{c}").alias(f"{side}_{c}") for side in "pq" for c in ("frame", "mx", "my", "area")])
    met = met.toDF("object", "own", *[f"{side}_{c}" for side in "pq" for c in ("frame", "mx", "my", "area")])

    @F.pandas_udf("struct<total:double,at:array<struct<later:long,ratio:double>>>")
    def pairs(own: pd.Series, *columns: pd.Series) -> pd.DataFrame:
        totals, found = [], []
        for same, frame, x, y, area, frame2, x2, y2, area2 in zip(own, *columns, strict=True):
            total, at = 0.0, []
            for k in range(0, len(frame), _ROWS):
                away = np.hypot(x[k : k + _ROWS, None] - x2, y[k : k + _ROWS, None] - y2)
                after = frame2 > frame[k : k + _ROWS, None] if same else np.ones(away.shape, bool)
                total += away[after].sum()
                far = after & (away > jump)
                first = far.argmax(axis=1)
                for row, j in enumerate(first.tolist()):
                    at.append((int(frame2[j]), float(area2[j] / area[k + row]) if area[k + row] > 0 else None) if far[row, j] else (None, None))
            totals.append(total)
            found.append(at)
        return pd.DataFrame({"total": totals, "at": found})

    done = met.select("object", "p_frame", pairs("own", *[f"{side}_{c}" for side in "pq" for c in ("frame", "mx", "my", "area")]).alias("r"))
    done = settled(done.select("object", "r.total", F.arrays_zip(F.col("p_frame").alias("frame"), F.col("r.at").alias("at")).alias("x")))
    n = blocks.groupBy("object").agg(F.sum(F.size("p")).cast("long").alias("n"))
    facts = n.join(done.groupBy("object").agg(F.sum("total").alias("total")), "object")
    facts = facts.select("object", "n", F.when(F.col("n") > 1, F.col("total") / (F.col("n") * (F.col("n") - 1) / 2)).otherwise(float("nan")).alias("mean"))
    each = done.select("object", F.explode("x").alias("x")).groupBy("object", F.col("x.frame").alias("frame")).agg(F.min(F.when(F.col("x.at.later").isNotNull(), F.struct("x.at.later", "x.at.ratio"))).alias("jump"))
    return each.join(facts, "object").select("object", "frame", F.col("jump.later").alias("later"), F.col("jump.ratio").alias("ratio"), "n", "mean")


def admitted(moved: DataFrame, least: int, displacement: float) -> DataFrame:
    """(object, n, mean) of tracks long and mobile enough, longest first."""
    return moved.groupBy("object").agg(F.max("n").alias("n"), F.max("mean").alias("mean")).where((F.col("n") >= least) & (F.col("mean") >= displacement)).orderBy(F.desc("n"), "object")


def reassigned(detections: DataFrame, threshold: float) -> DataFrame:
    """Detections that reach the threshold, with object numbered from 1 in each frame by order of arrival (line)."""
    rank = F.row_number().over(W.partitionBy("frame").orderBy("line"))
    return detections.where(F.col("score") >= threshold).withColumn("object", rank.cast("long"))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the last by ``order``."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(*keys, "_last.*")


def depth_order(boxes: DataFrame) -> DataFrame:
    """(frame, object, place) by a pairwise rule that isn't a total order: of two boxes that share columns the one that
    reaches lower comes later, others compare equal; a frame's boxes are one unit and sorted by comparison."""
    from functools import cmp_to_key

    def unit(part: pd.DataFrame) -> pd.DataFrame:
        rows = part.sort_values("object").to_dict("records")

        def compare(a: dict, b: dict) -> int:
            if min(a["x"] + a["w"], b["x"] + b["w"]) <= max(a["x"], b["x"]):
                return 0
            low_a, low_b = a["y"] + a["h"], b["y"] + b["h"]
            return (low_a > low_b) - (low_a < low_b)

        done = sorted(rows, key=cmp_to_key(compare))
        return pd.DataFrame({"frame": [r["frame"] for r in done], "object": [r["object"] for r in done], "place": range(len(done))})

    return boxes.groupBy("frame").applyInPandas(unit, "frame long, object long, place long")
