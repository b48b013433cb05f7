"""Connected parts of pixel grids, in two dimensions or three: labels inside tiles, joined over their borders."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.operators.graph import components, united
from cinefold.session import settled

#: Layers, rows and columns of a tile.
TILE = (8, 64, 64)
#: Half of the neighbours of a pixel, corners included: the others are theirs.
_AHEAD = [d for d in itertools.product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]


def _roots(places: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The number of the first pixel of every pixel's part, among pixels at (z, y, x) that stand in that order."""
    low = places.min(axis=0)
    size = places.max(axis=0) - low + 3  # an empty rim, so that steps don't run over
    flat = np.ravel_multi_index(tuple((places - low + 1).T), size)
    at = np.full(int(np.prod(size)), -1)
    at[flat] = np.arange(len(flat))

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for step in _AHEAD:
            other = at[flat + np.ravel_multi_index(tuple(np.array(step) + 1), size) - np.ravel_multi_index((1, 1, 1), size)]
            same = np.flatnonzero(other >= 0)
            same = same[values[same] == values[other[same]]]
            yield same, other[same]

    return united(len(flat), links())


def labelled(pixels: DataFrame, least: int = 1, tile: tuple[int, int, int] = TILE) -> DataFrame:
    """(key, z, y, x, value, blob, size) of (key, z, y, x, value): the first pixel (z, y, x) of each pixel's part, and its size.

    Pixels that touch, corners included, and have equal values are one part. Null and zero values are background and give
    no rows, as do parts of fewer than ``least`` pixels. A pixel is named once. A task holds a tile; between tiles only the
    pixels on their borders meet, and parts that touch there are joined as a graph, so a part may be of any size.
    """
    place = ["z", "y", "x"]
    cells = pixels.where("value <> 0").select("key", *[F.col(c).cast("long").alias(c) for c in place], "value")
    tiles = [F.floor(F.col(c) / n).cast("long").alias(f"t{c}") for c, n in zip(place, tile, strict=True)]
    names = [f"t{c}" for c in place]

    @F.pandas_udf("array<int>")
    def roots(cells: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([_roots(np.array([(c["z"], c["y"], c["x"]) for c in own], np.int64), np.asarray(v)) for own, v in zip(cells, values, strict=True)])

    held = cells.select("*", *tiles).groupBy("key", *names).agg(F.array_sort(F.collect_list(F.struct(*place, "value"))).alias("cells"))
    held = held.select("key", *names, "cells", roots(F.transform("cells", lambda c: F.struct(*[c[p].alias(p) for p in place])), F.transform("cells", lambda c: c["value"])).alias("roots"))
    within = settled(held.select("key", *names, F.explode(F.arrays_zip("cells", "roots")).alias("c")).select("key", *names, "c.cells.*", F.col("c.roots").alias("root")))
    parts = within.groupBy("key", *names, "root").agg(F.min(F.struct(*place)).alias("first"), F.count("*").alias("n"))
    parts = settled(parts.withColumn("part", F.monotonically_increasing_id()))  # fixed once written
    sides = [((F.col(c) % n == 0) | (F.col(c) % n == n - 1)) for c, n in zip(place, tile, strict=True)]
    rim = settled(within.where(sides[0] | sides[1] | sides[2]).join(parts.select("key", *names, "root", "part"), ["key", *names, "root"]).select("key", *names, *place, "value", "part"))
    step = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{c}") for c, x in zip(place, d, strict=True)]) for d in _AHEAD])).alias("d")
    here = rim.select("key", *names, *place, "value", F.col("part").alias("a"), step)
    here = here.select("key", "value", "a", *names, *[(F.col(c) + F.col(f"d.d{c}")).alias(c) for c in place])
    there = rim.select("key", "value", *place, F.col("part").alias("b"), *[F.col(n).alias(f"o{n}") for n in names])
    other = F.col("tz") != F.col("otz")
    for c in ("ty", "tx"):
        other = other | (F.col(c) != F.col(f"o{c}"))
    edges = here.join(there, ["key", "value", *place]).where(other).select("a", "b").distinct()
    joined = parts.join(components(edges).withColumnRenamed("node", "part"), "part", "left").withColumn("whole", F.coalesce("component", "part"))
    sums = joined.groupBy("whole").agg(F.min("first").alias("blob"), F.sum("n").alias("size")).where(F.col("size") >= least)
    named = joined.join(sums, "whole").select("key", *names, "root", "blob", "size")
    return within.join(named, ["key", *names, "root"]).select("key", *place, "value", "blob", "size")
