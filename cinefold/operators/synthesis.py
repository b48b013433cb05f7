"""Synthesis of sequences: costs of chains over frames, paths of instances, extension and reordering."""

from __future__ import annotations

from collections.abc import Callable
from math import log, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.operators.cost import FORBIDDEN
from cinefold.operators.distance import TASKS
from cinefold.session import settled

#: Cells of a matrix of moves that are worked out at a time.
_CELLS = 1 << 21


def chain_unaries(semantics: DataFrame, wanted: DataFrame, length: int, start: int | None = None, variance: float = 0.001) -> DataFrame:
    """(key, t, frame, cost): an even prior over all frames and times, and how far a frame's classes are from the wanted.

    ``semantics`` has (key, frame, weights) and ``wanted`` (key, t, weights) with one row, which then holds at all times,
    or one a time. Costs are minus logs, of a Gaussian with the same variance for every class. With ``start``, the first
    time allows that frame alone.
    """
    frames = semantics.groupBy("key").agg(F.count("*").alias("n"))
    one = wanted.groupBy("key").agg(F.count("*").alias("rows"), F.min_by("weights", "t").alias("first"))
    times = one.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).join(wanted.withColumnRenamed("weights", "own"), ["key", "t"], "left")
    times = times.select("key", "t", F.when(F.col("rows") == 1, F.col("first")).otherwise(F.col("own")).alias("goal"))
    gap = F.aggregate(F.zip_with("weights", "goal", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    constant = 0.5 * F.size("weights") * (log(2 * pi) + log(variance))
    out = semantics.join(times, "key").join(frames, "key")
    cost = F.log(F.col("n") * length) + constant + gap / (2 * variance)
    if start is not None:
        cost = F.when(F.col("t") > 0, cost).when(F.col("frame") == start, 0.0).otherwise(FORBIDDEN)
    return out.select("key", "t", "frame", cost.alias("cost"))


def chain_moves(frames: DataFrame, block: int = 512) -> DataFrame:
    """(key, i, j, cost) over (key, frame) with frames from 0: on to the next frame, waiting at the empty frame 0, and from
    the last to the first shown frame or to the empty one are free, all else is forbidden."""
    blocks = settled(frames.groupBy("key", F.floor(F.col("frame") / block).alias("b")).agg(F.collect_list("frame").alias("ids")))
    last = blocks.groupBy("key").agg(F.max(F.array_max("ids")).alias("last"))
    side = lambda c: blocks.select("key", F.col("b").alias(f"b{c}"), F.col("ids").alias(f"{c}s"))
    # Two blocks are a unit with a task of its own; a key's frames would make one task of their square.
    units = side("i").join(last, "key").join(side("j"), "key")
    units = units.repartition(min(TASKS, max(1, 2 * units.count())), "key", "bi", "bj")
    cells = units.select("key", "last", F.explode("is").alias("i"), "js").select("key", "last", "i", F.explode("js").alias("j"))
    free = (F.col("j") == F.col("i") + 1) | ((F.col("i") == 0) & (F.col("j") == 0)) | ((F.col("i") == F.col("last")) & F.col("j").isin(0, 1))
    return cells.select("key", "i", "j", F.when(free, 0.0).otherwise(FORBIDDEN).alias("cost"))


def likelihood_costs(semantics: DataFrame, wanted: DataFrame, variance: float, start: Column | None = None, banned: DataFrame | None = None) -> DataFrame:
    """(key, t, frame, cost) of (key, frame, weights) against (key, t, weights): minus log of each frame's share of a time's
    Gaussian likelihood. The first time allows ``start`` alone, if given; ``banned`` (key, t, frame) cells are forbidden."""
    gap = F.aggregate(F.zip_with("weights", "goal", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, x: a + x)
    met = semantics.join(wanted.select("key", "t", F.col("weights").alias("goal")), "key").withColumn("p", F.exp(-gap / (2 * variance)))
    share = F.col("p") / F.sum("p").over(W.partitionBy("key", "t"))
    met = met.select("key", "t", "frame", F.when(share > 0, -F.log(share)).otherwise(FORBIDDEN).alias("cost"))
    if start is not None:
        met = met.withColumn("cost", F.when(F.col("t") > 0, F.col("cost")).when(F.col("frame") == start, 0.0).otherwise(FORBIDDEN))
    if banned is None:
        return met
    held = banned.select("key", "t", "frame", F.lit(True).alias("_banned")).distinct()
    return met.join(held, ["key", "t", "frame"], "left").withColumn("cost", F.when(F.col("_banned"), FORBIDDEN).otherwise(F.col("cost"))).drop("_banned")


def _least(costs: pd.DataFrame, onward: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(t, frame, energy) of the least path through a table of costs, times by frames; ``onward`` gives every frame's least way from
    what the frames cost so far, and where it comes from."""
    rows, back = costs.to_numpy(), []
    best = rows[0]
    for row in rows[1:]:
        least, came = onward(best)
        back.append(came)
        best = least + row
    at = [int(best.argmin())]
    for b in reversed(back):
        at.append(int(b[at[-1]]))
    return pd.DataFrame({"t": costs.index, "frame": costs.columns.to_numpy()[at[::-1]], "energy": float(best.min())})


def _along(unaries: DataFrame, other: DataFrame, moving: Callable[[np.ndarray, pd.DataFrame], Callable]) -> DataFrame:
    key = dict(unaries.dtypes)["key"]

    def unit(_: tuple, own: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"key": [], "t": [], "frame": [], "energy": []}).astype({"t": "int64", "frame": "int64", "energy": "float64"})
        costs = own.pivot(index="t", columns="frame", values="cost")
        found = _least(costs, moving(costs.columns.to_numpy(), side))
        return found.assign(key=own["key"].iloc[0])[["key", "t", "frame", "energy"]]

    return unaries.groupBy("key").cogroup(other.groupBy("key")).applyInPandas(unit, f"key {key}, t long, frame long, energy double")


def paths(unaries: DataFrame, moves: DataFrame) -> DataFrame:
    """(key, t, frame, energy): each key's frames of least cost, first frame at ties.

    ``unaries`` has (key, t, frame, cost) for all frames and times, ``moves`` (key, i, j, cost). A key's matrix of moves
    and its costs are one unit, as large as the square of its frames; ``paths_between`` holds no matrix.
    """

    def moving(frames: np.ndarray, move: pd.DataFrame) -> Callable:
        table = np.full((len(frames), len(frames)), np.inf)
        table[np.searchsorted(frames, move["i"]), np.searchsorted(frames, move["j"])] = move["cost"]

        def onward(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            step = best[:, None] + table
            return step.min(axis=0), step.argmin(axis=0)

        return onward

    return _along(unaries, moves, moving)


def paths_between(unaries: DataFrame, values: DataFrame, move: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """``paths`` where moves cost what ``move(i, value of i, j, value of j)`` says of some frames i (columns) and j (rows).

    ``values`` are (key, frame, value). Costs of moves are worked out at each time, some frames at a time, so a key's unit
    is as large as its costs, and no pair of frames is written or shuffled.
    """

    def moving(frames: np.ndarray, own: pd.DataFrame) -> Callable:
        value = own.set_index("frame")["value"].reindex(frames).to_numpy()
        size = max(1, _CELLS // len(frames))

        def onward(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            least, came = np.empty(len(frames)), np.empty(len(frames), np.int64)
            for k in range(0, len(frames), size):
                step = move(frames[None], value[None], frames[k : k + size, None], value[k : k + size, None])
                step = step + best[None]
                at = step.argmin(axis=1)
                came[k : k + size], least[k : k + size] = at, step[np.arange(len(at)), at]
            return least, came

        return onward

    return _along(unaries, values, moving)


def tail_aligned(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """(key, t, a, b): two sequences' frames, shown together and run on until the shorter ends.

    ``pairs`` has (key, t, a, b) and ``lengths`` (key, a_length, b_length). After the last time both run on frame by frame
    as long as one of them has frames left; times at which a frame is negative or past its sequence's end are dropped. A
    pair that shows a negative frame at every time gives nothing.
    """
    rows = pairs.select("key", "t", "a", "b").join(lengths, "key")
    own = W.partitionBy("key").orderBy("t")
    rows = rows.withColumns({"_any": F.max((F.col("a") >= 0) & (F.col("b") >= 0)).over(W.partitionBy("key")), "_last": F.lead("key").over(own).isNull()})
    more = F.when(F.col("_last"), F.greatest(F.col("a_length") - F.col("a"), F.col("b_length") - F.col("b")) - 1).otherwise(0)
    # a row stands for itself, and the last one for what comes after it too
    each = rows.where("_any").withColumn("_k", F.explode(F.sequence(F.lit(0), F.greatest(more, F.lit(0)).cast("int"))))
    whole = each.select("key", *[(F.col(c) + F.col("_k")).alias(c) for c in ("t", "a", "b")], "a_length", "b_length")
    return whole.where("a >= 0 AND b >= 0 AND a < a_length AND b < b_length").select("key", "t", "a", "b")


def padded(wanted: DataFrame, current: int, length: int) -> DataFrame:
    """(key, t, weights): ``length`` rows from the current time on, the last one repeated where there are too few."""
    last = wanted.groupBy("key").agg(F.max("t").alias("end"), F.max_by("weights", "t").alias("final"))
    times = last.withColumn("t", F.explode(F.sequence(F.lit(current), F.lit(current + length - 1))))
    return times.join(wanted, ["key", "t"], "left").select("key", "t", F.coalesce("weights", "final").alias("weights"))


def extended(shown: DataFrame, new: DataFrame, current: int) -> DataFrame:
    """(key, t, frame): what is shown up to the current time, then the new frames without their first, which is the current."""
    after = new.where("t > 0").select("key", (F.col("t") + current).alias("t"), "frame")
    return shown.where(F.col("t") <= current).select("key", "t", "frame").unionByName(after)


def expanded(coarse: DataFrame, stride: int, start: Column) -> DataFrame:
    """(key, t, frame) from a path (key, t, frame) over every ``stride``-th frame: each step runs through its stride's frames
    where the next step follows on, and shows its first alone where the path jumps; frames before ``start`` of the first
    step are left out."""
    ahead = F.lead("frame").over(W.partitionBy("key").orderBy("t"))
    steps = coarse.withColumn("_next", ahead).withColumn("_n", F.when(F.col("_next").isNotNull() & (F.col("_next") != F.col("frame") + 1), 1).otherwise(stride))
    each = steps.select("key", "t", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("k"), "frame", start.alias("_start"))
    own = F.col("frame") * stride + F.col("k")
    order = F.row_number().over(W.partitionBy("key").orderBy("t", "k")) - 1
    kept = each.withColumn("_first", F.min("t").over(W.partitionBy("key"))).where((F.col("t") > F.col("_first")) | (F.col("k") >= F.col("_start")))
    return kept.select("key", order.cast("long").alias("t"), own.cast("long").alias("frame"))


def best_rotation(conflicting: list[int], fixed: list[int], solve: Callable[[list[int]], tuple[float, DataFrame]]) -> tuple[list[int], float, DataFrame]:
    """(order, cost, result) of the rotation of the conflicting instances, after the fixed ones, that costs least.

    ``solve`` gives the cost and the result of an order; of equal costs the last rotation holds. There are as many
    rotations as conflicting instances, and each is a distributed solution of its own.
    """
    best: tuple[list[int], float, DataFrame] | None = None
    for k in range(max(1, len(conflicting))):
        order = fixed + conflicting[len(conflicting) - k :] + conflicting[: len(conflicting) - k]
        cost, found = solve(order)
        if best is None or cost <= best[1]:
            best = order, cost, found
    return best
