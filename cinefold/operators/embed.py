"""Embeddings in the plane: steps of t-SNE with a quadtree of moments, and stress majorisation over any set of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.operators import distance
from cinefold.session import settled

#: Levels of the quadtree below its root, positions in a block of a leaf, and the last level whose cells are broadcast (4**level rows at most).
DEPTH, LEAF, SHALLOW = 20, 256, 5
#: The learning rate, least gain and exaggeration of the affinities, and the rounds in which momentum and exaggeration change.
RATE, LEAST_GAIN, EXAGGERATION, SOFT, EARLY = 500.0, 0.01, 4.0, 20, 100
#: Levels of the quadtree that are made at a time, and cells that are few enough to be sent to all tasks.
STRIDE, SENT = 7, 1 << 16
#: Positions that some others are measured against at a time.
TILE = 1024
_CELL = ["level", "cx", "cy"]


def symmetric(shares: DataFrame) -> DataFrame:
    """(i, j, value) summed with its transpose and divided by the sum of all: joint affinities, both ways round."""
    both = shares.select("i", "j", "value").unionByName(shares.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    both = settled(both.groupBy("i", "j").agg(F.sum("value").alias("value")))
    total = both.agg(F.sum("value")).first()[0]
    return both.withColumn("value", F.col("value") / F.lit(total))


def _at_levels(places: DataFrame, first: int, last: int) -> DataFrame:
    """Every position once for each of some levels' cell that holds it."""
    rows = places.withColumn("level", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return rows.withColumns({"cx": F.expr(f"shiftright(ix, {DEPTH} - level)"), "cy": F.expr(f"shiftright(iy, {DEPTH} - level)")})


def quadtree(points: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame, float]:
    """(cells, members, side of the root) of (x, y) points.

    Cells are (level, cx, cy, n, mx, my, open): how many points, their mean, and whether the cell has children, which it has
    while it holds more than ``leaf`` points above the deepest level. Members are (level, cx, cy, x, y, n): the distinct
    positions with their leaf and how many points share them. Some levels are made at a time, the next ones only from
    positions whose cell is still open, so what is shuffled doesn't grow with levels that hold no cells.
    """
    places = points.groupBy("x", "y").agg(F.count("*").alias("n"))
    b = points.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    side = 1.0 if b["x0"] is None else max(b["x1"] - b["x0"], b["y1"] - b["y0"]) or 1.0
    number = lambda c, low: F.least(F.floor((F.col(c) - F.lit(low)) / side * (1 << DEPTH)), F.lit((1 << DEPTH) - 1)).cast("long")
    rest = settled(places.withColumns({"ix": number("x", b["x0"]), "iy": number("y", b["y0"])}))
    tree, members = None, None
    for first in range(0, DEPTH + 1, STRIDE):
        last = min(first + STRIDE - 1, DEPTH)
        rows = _at_levels(rest, first, last)
        sums = rows.groupBy(*_CELL).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("sx"), F.sum(F.col("n") * F.col("y")).alias("sy"))
        cells = sums.withColumn("open", (F.col("n") > leaf) & (F.col("level") < DEPTH))
        cells = settled(cells.select(*_CELL, "n", (F.col("sx") / F.col("n")).alias("mx"), (F.col("sy") / F.col("n")).alias("my"), "open"))
        parents = cells.where("open").select((F.col("level") + 1).alias("level"), F.col("cx").alias("px"), F.col("cy").alias("py"))
        child = cells.withColumns({"px": F.expr("shiftright(cx, 1)"), "py": F.expr("shiftright(cy, 1)")})
        cells = settled(child.join(parents, ["level", "px", "py"], "left_semi").drop("px", "py").unionByName(cells.where(f"level = {first}")))
        leaves = cells.where("not open").select(*_CELL, F.col("n").alias("held"))
        own = rows.join(F.broadcast(leaves) if leaves.count() <= SENT else leaves, _CELL).select(*_CELL, "x", "y", "n", "held")
        tree, members = (cells, own) if tree is None else (tree.unionByName(cells), members.unionByName(own))
        further = cells.where(f"open and level = {last}").select(*_CELL)
        many = further.count()
        if not many:
            break
        rest = settled(_at_levels(rest, last, last).join(F.broadcast(further) if many <= SENT else further, _CELL, "left_semi").drop(*_CELL))
    return tree, members, side


def _kernel(rows: pd.DataFrame) -> pd.DataFrame:
    """For each row's targets (tx, ty): sums over its sources (sx, sy, sn) of n q and n q^2 (target - source), q = 1 / (1 + d^2)."""
    parts = []
    for tx, ty, sx, sy, sn in zip(*(rows[c] for c in ("tx", "ty", "sx", "sy", "sn")), strict=True):
        tx, ty, sx, sy, sn = (np.asarray(v, float) for v in (tx, ty, sx, sy, sn))
        dx, dy = tx[:, None] - sx, ty[:, None] - sy
        q = 1 / (1 + dx * dx + dy * dy)
        parts.append(np.column_stack((tx, ty, q @ sn, (q * q * dx) @ sn, (q * q * dy) @ sn)))
    return pd.DataFrame(np.concatenate(parts) if parts else np.empty((0, 5)), columns=["x", "y", "z", "fx", "fy"])


def _pushed(x: distance.Side, y: distance.Side) -> Iterator[pd.DataFrame]:
    """``_kernel``'s sums of every left position over all right ones, whose state is how many points they are, some at a time."""
    for part in distance.parts(x):
        (tx, ty), sums = part.pixels.T, np.zeros((len(part.ids), 4))
        for k in range(0, len(y.ids), TILE):
            (sx, sy), n = y.pixels[k : k + TILE].T, y.state[k : k + TILE, 0]
            q, d = tx[:, None] - sx, ty[:, None] - sy
            q *= q
            d *= d
            q += d
            q += 1
            np.reciprocal(q, out=q)
            sums[:, 0] += q @ n
            q *= q
            sums[:, 1:] += q @ np.column_stack((n, n * sx, n * sy))
        z, w, wx, wy = sums.T
        yield pd.DataFrame({"x": tx, "y": ty, "z": z, "fx": tx * w - wx, "fy": ty * w - wy})


def repulsion_of_all(points: DataFrame) -> DataFrame:
    """``repulsion`` from every pair of positions: blocks of them meet two by two, in tasks of their own, and each gives a row a position."""
    places = settled(points.groupBy("x", "y").agg(F.count("*").alias("n")))
    sides = places.select(F.xxhash64("x", "y").alias("frame"), F.array("x", "y").alias("pixels"), F.array(F.col("n").cast("double")).alias("state"))
    sums = distance.units(sides, sides, _pushed, "x double, y double, z double, fx double, fy double").groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("z", "fx", "fy")])
    return places.join(sums, ["x", "y"]).select("x", "y", "n", (F.col("z") - 1).alias("z"), "fx", "fy")


def repulsion(points: DataFrame, angle: float, leaf: int = LEAF) -> DataFrame:
    """(x, y, n, z, fx, fy): for each distinct position, the sums over all other points of q and of q^2 (y_i - y_j).

    A leaf's block of positions walks the tree level by level. A cell whose side is at most ``angle`` times the distance of
    its mean from the block's box acts as that many points at its mean; others are opened, and leaves meet the block
    position by position. At angle 0 nothing is summed up, so there is no tree, and the result is exact. The walk is a join of
    blocks and cells, which are a leaf's worth fewer than the points. A leaf at the deepest level may be of any size and is dealt into blocks.
    """
    if angle <= 0:
        return repulsion_of_all(points)
    tree, members, side = quadtree(points, leaf)
    block = members.withColumn("part", F.pmod(F.xxhash64("x", "y"), F.ceil(F.col("held") / leaf)))
    blocks = settled(block.groupBy(*_CELL, "part").agg(F.collect_list(F.struct("x", "y", "n")).alias("own"), *[f(c).alias(f"{n}_{c}") for c in "xy" for n, f in (("low", F.min), ("high", F.max))]))
    unit = F.struct(*_CELL, "part").alias("unit")
    front = blocks.select(unit, *[f"{n}_{c}" for n in ("low", "high") for c in "xy"], F.lit(0).alias("level"), F.lit(0).cast("long").alias("cx"), F.lit(0).cast("long").alias("cy"))
    away = lambda c: F.greatest(F.lit(0.0), F.col(f"low_{c}") - F.col(f"m{c}"), F.col(f"m{c}") - F.col(f"high_{c}"))
    far, near = [], []
    for level in range((tree.agg(F.max("level")).first()[0] or 0) + 1):
        cells = tree.where(F.col("level") == level)
        met = front.join(F.broadcast(cells) if level <= SHALLOW else cells, _CELL)
        met = settled(met.withColumn("whole", F.lit(side / 2**level) <= angle * F.hypot(away("x"), away("y"))))
        far.append(met.where("whole").select("unit", "mx", "my", "n"))
        near.append(met.where("not whole and not open").select("unit", *_CELL))
        child = F.explode(F.array(*[F.struct((2 * F.col("cx") + a).alias("cx"), (2 * F.col("cy") + b).alias("cy")) for a in (0, 1) for b in (0, 1)]))
        front = met.where("not whole and open").withColumn("child", child).select("unit", *[f"{n}_{c}" for n in ("low", "high") for c in "xy"], F.lit(level + 1).alias("level"), "child.cx", "child.cy")
    united = lambda parts: parts[0] if len(parts) == 1 else united([*parts[2:], parts[0].unionByName(parts[1])])
    sources = united(near).join(blocks.select(*_CELL, F.col("own").alias("sources")), _CELL).select("unit", "sources")
    means = united(far).groupBy("unit").agg(F.collect_list(F.struct(F.col("mx").alias("x"), F.col("my").alias("y"), "n")).alias("sources"))
    work = sources.unionByName(means).join(blocks.select(unit, "own"), "unit")
    work = work.select(*[F.col(f"own.{c}").alias(f"t{c}") for c in "xy"], *[F.col(f"sources.{c}").alias(f"s{c}") for c in "xyn"])
    sums = work.mapInPandas(lambda batches: map(_kernel, batches), "x double, y double, z double, fx double, fy double").groupBy("x", "y").agg(*[F.sum(c).alias(c) for c in ("z", "fx", "fy")])
    return members.select("x", "y", "n").join(sums, ["x", "y"]).select("x", "y", "n", (F.col("z") - 1).alias("z"), "fx", "fy")


def tsne_gradient(points: DataFrame, affinities: DataFrame, angle: float = 0.5, leaf: int = LEAF) -> DataFrame:
    """(i, gx, gy): the slope of t-SNE's divergence at (i, x, y) points, over 4, as sum over j of (p - q) (y_i - y_j) / (1 + d^2).

    ``affinities`` are (i, j, value), both ways round; pairs that aren't there have none, so the pull costs what they count.
    """
    points = points.select("i", "x", "y")
    push = settled(repulsion(points, angle, leaf))
    total = push.agg(F.sum(F.col("n") * F.col("z"))).first()[0] or 1.0
    there = points.select(F.col("i").alias("j"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    pairs = affinities.join(there, "j").join(points, "i")
    dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
    q = F.col("value") / (1 + dx * dx + dy * dy)
    pull = pairs.groupBy("i").agg(F.sum(q * dx).alias("ax"), F.sum(q * dy).alias("ay"))
    both = points.join(push, ["x", "y"]).join(pull, "i", "left")
    return both.select("i", *[(F.coalesce(F.col(f"a{c}"), F.lit(0.0)) - F.col(f"f{c}") / total).alias(f"g{c}") for c in "xy"])


def tsne(start: DataFrame, affinities: DataFrame, rounds: int, angle: float = 0.5, rate: float = RATE, leaf: int = LEAF) -> DataFrame:
    """(i, x, y) after some rounds of t-SNE from (i, x, y), with momentum and a gain for each coordinate kept as columns.

    A gain grows by 0.2 where slope and last step have different signs, else shrinks to 0.8 of itself. Affinities count
    fourfold for the first hundred rounds, momentum is 0.5 for twenty and 0.8 then, and points are centred after each.
    """
    affinities = settled(affinities.select("i", "j", "value"))
    state = settled(start.select("i", *[F.col(c).cast("double").alias(c) for c in "xy"], *[F.lit(v).alias(f"{n}{c}") for n, v in (("v", 0.0), ("gain", 1.0)) for c in "xy"]))
    for k in range(rounds):
        pulls = affinities.withColumn("value", F.col("value") * (EXAGGERATION if k < EARLY else 1.0))
        state = state.join(tsne_gradient(state, pulls, angle, leaf), "i")
        for c in "xy":
            turned = (F.col(f"g{c}") > 0) != (F.col(f"v{c}") > 0)
            state = state.withColumn(f"gain{c}", F.greatest(F.lit(LEAST_GAIN), F.when(turned, F.col(f"gain{c}") + 0.2).otherwise(F.col(f"gain{c}") * 0.8)))
            state = state.withColumn(f"v{c}", (0.5 if k < SOFT else 0.8) * F.col(f"v{c}") - rate * F.col(f"gain{c}") * F.col(f"g{c}"))
            state = state.withColumn(c, F.col(c) + F.col(f"v{c}"))
        state = settled(state.drop("gx", "gy"))
        middle = state.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
        if middle["x"] is not None:
            state = state.withColumns({c: F.col(c) - F.lit(middle[c]) for c in "xy"})
    return state.select("i", "x", "y")


def _stretched(points: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with both ends and their distance."""
    ends = pairs.join(points.select("i", "x", "y"), "i").join(points.select(F.col("i").alias("j"), F.col("x").alias("ox"), F.col("y").alias("oy")), "j")
    return ends.withColumn("d", F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")))


def stress_rounds(start: DataFrame, pairs: DataFrame, rounds: int) -> tuple[list[float], DataFrame]:
    """The stress before each round and after the last, and the points (i, x, y) then.

    Stress is the sum over (i, j, target, weight) pairs, each named once, of weight (distance - target)^2. Both ends of a pair
    ask for the place half a target away from the pair's middle, along the line between them; each point goes to the
    weighted mean of what it is asked. That is the least value of a bound which touches the stress at the points as they
    are, so stress never rises. Weights aren't negative; points at one place stay together, those without a pair stay as they are.
    """
    points = settled(start.select("i", *[F.col(c).cast("double").alias(c) for c in "xy"]))
    pairs = settled(pairs.where("i <> j and weight > 0").select("i", "j", "target", "weight"))
    record, both = [], pairs.unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "target", "weight"))
    stress = lambda p: _stretched(p, pairs).agg(F.coalesce(F.sum(F.col("weight") * F.pow(F.col("d") - F.col("target"), 2)), F.lit(0.0))).first()[0]
    record.append(stress(points))
    for _ in range(rounds):
        part = F.when(F.col("d") > 0, F.col("target") / F.col("d")).otherwise(0.0)
        asked = lambda c: ((F.col(c) + F.col(f"o{c}")) + part * (F.col(c) - F.col(f"o{c}"))) / 2  # noqa: B023, E731
        moved = _stretched(points, both).groupBy("i").agg(*[(F.sum(F.col("weight") * asked(c)) / F.sum("weight")).alias(f"n{c}") for c in "xy"])
        points = settled(points.join(moved, "i", "left").select("i", *[F.coalesce(f"n{c}", c).alias(c) for c in "xy"]))
        record.append(stress(points))
    return record, points
