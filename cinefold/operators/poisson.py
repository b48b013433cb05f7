"""Gradient-domain blending: sparse Laplace systems over pixels, solved by conjugate gradients on (key, row, column, value) tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.session import settled, small_batches

#: Most pixels of a key that is solved in one row.
SMALL = 1024


def conjugate_gradients(matrix: DataFrame, right: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """(key, row, value, residual) of the solutions of many systems: ``matrix`` (key, row, column, value), symmetric and
    positive definite for every key, and ``right`` (key, row, value).

    All keys advance at once, each with its own steps, until every residual's norm is at most the tolerance; ``residual``
    is its square. A product is a join on the column and a sum by row, so a system may be larger than any task; what the
    driver sees is whether a key goes on. Rows without an entry in ``right`` have 0 there; null values count as 0.
    """
    entries = settled(matrix.select("key", F.col("row"), F.col("column"), F.col("value").cast("double").alias("a")))
    rows = entries.select("key", "row").distinct().join(right.select("key", "row", F.col("value").cast("double").alias("r")), ["key", "row"], "left")
    rows = rows.select("key", "row", F.lit(0.0).alias("x"), F.coalesce("r", F.lit(0.0)).alias("r")).withColumn("p", F.col("r"))
    dot = lambda a, b: F.sum(F.col(a) * F.col(b))
    state = settled(rows.join(rows.groupBy("key").agg(dot("r", "r").alias("rr")), "key"))
    far = F.col("rr") > tolerance * tolerance
    while not state.where(far).isEmpty():
        moving = state.where(far)
        product = entries.join(moving.select("key", F.col("row").alias("column"), "p"), ["key", "column"]).groupBy("key", "row").agg(F.sum(F.col("a") * F.col("p")).alias("q"))
        moving = moving.drop("rr").join(product, ["key", "row"])
        sums = moving.groupBy("key").agg(dot("r", "r").alias("old"), dot("p", "q").alias("pq"), dot("r", "q").alias("rq"), dot("q", "q").alias("qq"))
        # the next residual's square follows from these sums, so that one pass does a step; it is summed anew in the next
        sums = sums.withColumn("length", F.when(F.col("pq") > 0, F.col("old") / F.col("pq")).otherwise(0.0))
        new = F.greatest(F.lit(0.0), F.col("old") - 2 * F.col("length") * F.col("rq") + F.col("length") * F.col("length") * F.col("qq"))
        sums = sums.withColumn("rr", F.when(F.col("length") == 0, 0.0).otherwise(new))
        moved = moving.join(sums, "key").withColumns({"x": F.col("x") + F.col("length") * F.col("p"), "r": F.col("r") - F.col("length") * F.col("q")})
        moved = moved.withColumn("p", F.col("r") + F.when(F.col("old") > 0, F.col("rr") / F.col("old")).otherwise(0.0) * F.col("p"))
        state = settled(moved.select("key", "row", "x", "r", "p", "rr").unionByName(state.where(~far)))
    return state.select("key", "row", F.col("x").alias("value"), F.col("rr").alias("residual"))


def _solved(part: np.ndarray, y: np.ndarray, x: np.ndarray, source: np.ndarray, target: np.ndarray, inside: np.ndarray, tolerance: float) -> np.ndarray:
    """The values of all pixels of several systems at once, before they are held between bounds; ``part`` numbers the systems from 0."""
    ranks = [np.unique(np.concatenate((c - 1, c, c + 1))) for c in (y, x)]
    code = lambda a, b: (part * len(ranks[0]) + np.searchsorted(ranks[0], a)) * len(ranks[1]) + np.searchsorted(ranks[1], b)
    order = np.argsort(code(y, x), kind="stable")
    names = code(y, x)[order]
    free = np.flatnonzero(inside)
    number = np.full(len(y) + 1, len(free))  # beyond the grid and outside: one unknown more, which stays 0
    number[free] = np.arange(len(free))
    r, beside = 4 * source[free], []
    for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1)):
        wanted = code(y + dy, x + dx)[free]
        at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
        there = names[at] == wanted
        other = order[at]
        r += np.where(there, np.where(inside[other], 0.0, target[other]) - source[other], 0.0)
        beside.append(number[np.where(there, other, len(y))])
    of, n = part[free], int(part.max()) + 1
    dot = lambda a, b: np.bincount(of, a * b, n)
    v, p = np.zeros(len(free)), np.append(r, 0.0)
    rr = dot(r, r)
    while (far := rr > tolerance * tolerance).any():
        q = 4 * p[:-1] - sum(p[b] for b in beside)
        pq = dot(p[:-1], q)
        length = np.where(far & (pq > 0), rr / np.where(pq > 0, pq, 1.0), 0.0)
        v += length[of] * p[:-1]
        r = r - length[of] * q
        new = np.where(far & (length == 0), 0.0, dot(r, r))
        p[:-1] = r + (np.where(far, new, 0.0) / np.where(rr > 0, rr, 1.0))[of] * p[:-1]
        rr = np.where(far, new, rr)
    out = target.copy()
    out[free] = v
    return out


def _blended_small(cells: DataFrame, tolerance: float) -> DataFrame:
    """(key, y, x, blended, target) of keys with few pixels: a key is one row, and those of a batch are solved together."""
    names = ("y", "x", "source", "target", "inside")
    packed = cells.groupBy("key").agg(F.collect_list(F.struct(*names)).alias("c")).select("key", *[F.col(f"c.{n}").alias(n) for n in names])

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sizes = batch["y"].map(len).to_numpy()
                flat = {n: np.concatenate(batch[n].tolist()) for n in names}
                blended = _solved(np.repeat(np.arange(len(batch)), sizes), *flat.values(), tolerance)
                key = batch["key"].repeat(sizes).reset_index(drop=True)
                yield pd.DataFrame({"key": key, "y": flat["y"], "x": flat["x"], "blended": blended, "target": flat["target"]})

    kinds = {n: f.dataType.simpleString() for n, f in zip(cells.columns, cells.schema.fields, strict=True)}
    with small_batches(cells.sparkSession):
        return settled(packed.mapInPandas(solved, f"key {kinds['key']}, y {kinds['y']}, x {kinds['x']}, blended double, target double"))


def _blended_large(cells: DataFrame, tolerance: float) -> DataFrame:
    """(key, y, x, blended, target) of keys of any size; ``blended`` is null outside."""
    near = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("d")
    place = F.struct("y", "x")
    around = cells.where("inside").select("key", place.alias("row"), near).select("key", "row", (F.col("row.y") + F.col("d.dy")).alias("y"), (F.col("row.x") + F.col("d.dx")).alias("x"))
    met = settled(around.join(cells, ["key", "y", "x"], "left"))
    centre = cells.where("inside").select("key", place.alias("row"), place.alias("column"), F.lit(4.0).alias("value"))
    beside = met.where("inside").select("key", "row", F.struct("y", "x").alias("column"), F.lit(-1.0).alias("value"))
    known = met.groupBy("key", "row").agg(F.sum(F.coalesce(F.when(~F.col("inside"), F.col("target")), F.lit(0.0)) - F.coalesce("source", F.lit(0.0))).alias("known"))
    right = known.join(cells.where("inside").select("key", place.alias("row"), "source"), ["key", "row"]).select("key", "row", (4 * F.col("source") + F.col("known")).alias("value"))
    solved = conjugate_gradients(centre.union(beside), right, tolerance).select("key", F.col("row.y").alias("y"), F.col("row.x").alias("x"), F.col("value").alias("blended"))
    return cells.join(solved, ["key", "y", "x"], "left").select("key", "y", "x", "blended", "target")


def blend(pixels: DataFrame, low: float = 0.0, high: float = 255.0, tolerance: float = 1e-9, small: int = SMALL) -> DataFrame:
    """(key, y, x, value) of (key, y, x, source, target, inside): the target, with the source's gradients where ``inside``.

    An inside pixel's Laplacian is the source's, with what is missing around the source taken as 0; other pixels, and
    beyond them the edge of the grid, keep the target. Values are held between ``low`` and ``high``. Every key is a
    system of its own; null ``inside`` is outside, null values are 0. Keys of at most ``small`` pixels are solved in a row each,
    larger ones as tables of their entries.
    """
    cells = settled(pixels.select("key", "y", "x", *(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in ("source", "target")), F.coalesce("inside", F.lit(False)).alias("inside")))
    large = settled(cells.groupBy("key").count().where(F.col("count") > small).select("key"))
    if large.isEmpty():
        found = _blended_small(cells, tolerance)
    else:
        found = _blended_small(cells.join(large, "key", "left_anti"), tolerance).unionByName(_blended_large(cells.join(large, "key", "left_semi"), tolerance))
    value = F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce("blended", "target")))
    return found.select("key", "y", "x", value.alias("value"))
