"""Least seams through grids from top to bottom: shortest ways between the pixels, worked out in blocks of rows.

A seam that parts a grid's first column from its last is a way over the edges it cuts, from above the first row to below
the last. Places lie between two neighbouring columns, above a row or below it; a step down or up cuts the edge between a
row's pixels, a step aside that between a pixel and the one below. What a cut costs at least is the shortest such way,
which is also the largest flow from the first column to the last.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.operators.graphcut import UNITS
from cinefold.session import settled

#: Rows of a block, of its parts that are swept at a time, and blocks that are put together at a time.
ROWS, PART, TOGETHER = 256, 16, 16
#: Longer than any way.
FAR = 1 << 60


def _whole(cost: np.ndarray) -> np.ndarray:
    """Costs in whole units, halves up."""
    units = np.nan_to_num(cost, nan=0.0, posinf=1e7 * UNITS, neginf=0.0) * UNITS
    low = np.floor(units)
    return (low + (units - low >= 0.5)).astype(np.int64)


def _aside(d: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances (place, source) of a row's places after steps aside; ``at`` is each place's way from the first one."""
    right = np.minimum.accumulate(d - at, axis=0) + at
    left = np.minimum.accumulate((d + at)[::-1], axis=0)[::-1] - at
    return np.minimum(right, left)


def _ends(down: np.ndarray, aside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ways inside a block between its top places, from top to bottom, and between its bottom places.

    ``down`` (rows, places) are the costs of steps over a row, ``aside`` (rows, places - 1) those of steps below it. Rows are
    swept down and up, from all top and bottom places at once, until no distance falls any more.
    """
    n, width = down.shape
    d = np.full((n + 1, width, 2 * width), FAR)
    d[0, :, :width][np.diag_indices(width)] = 0
    d[n, :, width:][np.diag_indices(width)] = 0
    at = np.concatenate((np.zeros((n, 1), np.int64), np.cumsum(aside, axis=1)), axis=1)[:, :, None]
    step = down[:, :, None]
    d[n] = _aside(d[n], at[n - 1])
    fresh = np.ones(n + 1, bool)  # rows that fell since their neighbours saw them
    while fresh.any():
        seen, fresh = fresh, np.zeros(n + 1, bool)
        for rows, before in ((range(1, n + 1), -1), (range(n - 1, -1, -1), 1)):
            for f in rows:
                if not (seen[f + before] or fresh[f + before]):
                    continue
                new = np.minimum(d[f], d[f + before] + step[f - 1 if before < 0 else f])
                if f:
                    new = _aside(new, at[f - 1])
                if (new < d[f]).any():
                    d[f], fresh[f] = new, True
    d = np.minimum(d[[0, n]], FAR)
    return d[0, :, :width], d[1, :, :width].T, d[1, :, width:]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The shortest ways that go by ``a`` and then by ``b``."""
    out = np.full((a.shape[0], b.shape[1]), FAR)
    for k in range(a.shape[1]):
        np.minimum(out, a[:, k, None] + b[k], out=out)
    return out


def _joined(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The ways between the ends of two blocks, one below the other; a way may cross their border any number of times."""
    middle = np.minimum(a[2], b[0])
    for k in range(len(middle)):
        np.minimum(middle, middle[:, k, None] + middle[k], out=middle)
    into, out_of = _times(a[1], middle), _times(b[1].T, middle)
    return np.minimum(a[0], _times(into, a[1].T)), _times(into, b[1]), np.minimum(b[2], _times(out_of, b[1]))


def _united(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The ways between the ends of several blocks in order."""
    while len(parts) > 1:
        parts = [_joined(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0]


def least_seams(rows: DataFrame, width: int, block: int = ROWS) -> DataFrame:
    """(key, cost) of the least seam between the first and the last of ``width`` columns, 2 or more, of every key.

    ``rows`` are (key, y, gaps), each row of a grid once with an array of its pixels' gaps: two neighbours, beside or below each
    other, cost the sum of theirs to part, in whole millionths; what is null, missing or beyond the columns costs nothing.
    Each block of rows gives the ways between its ends, and neighbouring blocks are put together until a key is one, so what
    a task holds is one block, or the ends of a few.
    """
    at = F.floor(F.col("y") / block).cast("long")
    # a block's last row is parted from the next block's first
    blocks = F.explode(F.when((F.col("y") % block == 0) & (F.col("y") > 0), F.array(at - 1, at)).otherwise(F.array(at))).alias("block")
    dealt = rows.where("y IS NOT NULL").select("key", "y", "gaps", blocks).withColumn("y", (F.col("y") - F.col("block") * block).cast("int"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, block long, ends binary"

    def ends(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        gaps = np.full((int(part["y"].max()) + 1, width), np.nan)
        for y, row in zip(part["y"], part["gaps"], strict=True):
            row = np.asarray(row if row is not None else (), float)[:width]
            gaps[y, : len(row)] = row
        below = _whole(gaps[:-1] + gaps[1:])[:block, 1:-1]
        down = _whole(gaps[:block, :-1] + gaps[:block, 1:])
        aside = np.zeros((len(down), width - 2), np.int64)
        aside[: len(below)] = below
        parts = [_ends(down[k : k + PART], aside[k : k + PART]) for k in range(0, len(down), PART)]
        return pd.DataFrame({"key": [group[0]], "block": [group[1]], "ends": [np.stack(_united(parts)).tobytes()]})

    def together(group: tuple, part: pd.DataFrame) -> pd.DataFrame:
        parts = [tuple(np.frombuffer(x, np.int64).reshape(3, width - 1, width - 1)) for x in part.sort_values("block")["ends"]]
        return pd.DataFrame({"key": [group[0]], "block": [group[1]], "ends": [np.stack(_united(parts)).tobytes()]})

    found = settled(dealt.groupBy("key", "block").applyInPandas(ends, schema))
    while found.where("block > 0").count():
        found = settled(found.withColumn("block", F.floor(F.col("block") / TOGETHER).cast("long")).groupBy("key", "block").applyInPandas(together, schema))

    @F.pandas_udf("long")
    def least(ends: pd.Series) -> pd.Series:
        return pd.Series([int(np.frombuffer(x, np.int64).reshape(3, -1)[1].min()) for x in ends])

    return found.select("key", (least("ends") / UNITS).alias("cost"))
