"""Distances between frames: blocks of rows meet two by two, and each pair of blocks is one bounded unit of work."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.operators.graph import united
from cinefold.session import settled

#: Rows in a block of sums along diagonals; most rows in any other block; blocks
#: a side that smaller tables are dealt into; most tasks that units are dealt to.
BLOCK, WIDE, SPREAD, TASKS = 2048, 16384, 8, 2048
#: Right columns whose least distance stands for them at first, and blocks that a left block of nearest rows has the size of.
GROUP, TALL = 16, 4
#: Rows that are measured against a block at a time, and pairs that are looked at again.
_CHUNK, _AGAIN = 64, 1 << 15
#: Right rows that meet a few left rows at a time where pairs are only summed up, so that their numbers stay in a core's cache.
TILE = 2048
#: Pairs of rows that are counted at a time, and most sets whose facts are sent to all tasks.
_PAIRS, SENT = 1 << 21, 1 << 19
#: Pairs that may be linked and are measured again at a time.
_LINKS = 1 << 15
#: Most points in a cell of a grid in the plane.
CROWD = 20_000
#: Buckets of a histogram, and numbers that are few enough to be collected.
BUCKETS, FEW = 4096, 20_000


def _packed(side: DataFrame, kind: str, number: Column) -> DataFrame:
    """(own, ids, flat, state, widths): one row a block, by a number of the row; ``state`` holds numbers a row has beside its pixels."""
    state = F.col("state") if "state" in side.columns else F.array().cast("array<double>")
    rows = side.select(number.alias("own"), F.struct("frame", F.col("pixels").cast(kind).alias("pixels"), state.alias("state")).alias("r"))
    rows = rows.groupBy("own").agg(F.array_sort(F.collect_list("r"), lambda x, y: F.when(x["frame"] < y["frame"], -1).when(x["frame"] > y["frame"], 1).otherwise(0)).alias("r"))
    widths = F.array_distinct(F.transform("r", lambda x: F.size(x["pixels"])))
    return rows.select("own", F.col("r.frame").alias("ids"), F.flatten("r.pixels").alias("flat"), F.flatten("r.state").alias("state"), widths.alias("widths"))


def _kind(*sides: DataFrame) -> str:
    """What pixels are sent as: floats stay floats, which is half the bytes; all else is doubles."""
    return "array<float>" if all(dict(side.dtypes)["pixels"] == "array<float>" for side in sides) else "array<double>"


def _blocks(n: int, m: int, block: int) -> tuple[int, int]:
    """How many blocks two sides are dealt into: of ``block`` rows at most, more where that leaves cores idle, the larger side into more."""
    a = max(-(-n // block), min(round(SPREAD * (n / max(1, m)) ** 0.5), n // 64), 1)
    return a, max(-(-m // block), min(-(-(SPREAD**2) // a), m // 64), 1)


class Side:
    """One side of a unit: ids in ascending order, their pixels in double precision and the numbers beside them."""

    def __init__(self, ids, flat, state, widths):
        if len(widths) != 1:
            raise ValueError(f"rows of a block have pixels of {sorted(widths)} components")
        self.ids = np.asarray(ids)
        self.pixels = np.asarray(flat, float).reshape(len(self.ids), widths[0])
        self.state = np.asarray(state, float).reshape(-1, max(1, len(state) // len(self.ids)))

    @cached_property
    def squares(self) -> np.ndarray:
        """Squared lengths of the pixels."""
        with np.errstate(invalid="ignore", over="ignore"):
            return (self.pixels * self.pixels).sum(axis=1)


def units(left: DataFrame, right: DataFrame, fold: Callable[[Side, Side], Iterator[pd.DataFrame]], schema: str, block: int = WIDE) -> DataFrame:
    """What ``fold`` gives for every two blocks of (frame, pixels) rows, which are dealt by a hash of the frame.

    A block is one row, so what is shuffled is the rows once for each block of the other side, without a key a row.
    """
    n, m = _blocks(left.count(), right.count(), block)
    kind, number = _kind(left, right), lambda k: F.pmod(F.xxhash64("frame"), F.lit(k)).cast("int")
    each = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    x = _packed(left, kind, number(n)).select(F.col("own").alias("a"), each(m).alias("b"), F.lit(0).alias("side"), "ids", "flat", "state", "widths")
    y = _packed(right, kind, number(m)).select(each(n).alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), "ids", "flat", "state", "widths")
    return _folded(x.unionByName(y), fold, schema, n * m)


def _folded(sides: DataFrame, fold: Callable[[Side, Side], Iterator[pd.DataFrame]], schema: str, count: int) -> DataFrame:
    """What ``fold`` gives for every unit's two sides. Units are dealt to a number of tasks of their own: their work is the
    square of what they read, so tasks mustn't be put together by the bytes they read."""

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = {}
        for batch in batches:
            for side, *packed in zip(*(batch[c] for c in ("side", "ids", "flat", "state", "widths")), strict=True):
                found[side] = Side(*packed)
        if len(found) == 2:
            yield from fold(found[0], found[1])

    return sides.repartition(min(TASKS, 2 * count), "a", "b").groupBy("a", "b").applyInPandas(unit, schema)


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances term by term, some columns at a time, as every pair's terms are held."""
    size = max(1, _AGAIN // max(1, len(x)))
    return np.concatenate([((x[:, None] - y[None, k : k + size]) ** 2).sum(axis=2) for k in range(0, max(1, len(y)), size)], axis=1)


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x @ y.T


def gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by products of matrices, and term by term where the difference of their squares would lose digits."""
    with np.errstate(invalid="ignore", over="ignore"):
        return _gaps_of(x, y, (x * x).sum(axis=1), (y * y).sum(axis=1))


def _gaps_of(x: np.ndarray, y: np.ndarray, xx: np.ndarray, yy: np.ndarray) -> np.ndarray:
    """``gaps`` from the rows' squares."""
    with np.errstate(invalid="ignore", over="ignore"):
        d = x @ y.T
        d *= -2
        d += yy
        d += xx[:, None]
        if xx.max(initial=0) + yy.max(initial=0) < 1e300:
            close = d <= 1e-3 * (xx + yy.max(initial=0))[:, None]  # no fewer than those that lose digits
            rows = np.flatnonzero(close.any(axis=1))
            r, c = np.nonzero(close[rows])
            r = rows[r]
            lost = d[r, c] <= 1e-3 * (xx[r] + yy[c])
            r, c = r[lost], c[lost]
        else:
            r, c = np.nonzero(~(d > 1e-3 * (xx[:, None] + yy[None])) | ~np.isfinite(d))
        for k in range(0, len(r), _AGAIN):
            a, b = r[k : k + _AGAIN], c[k : k + _AGAIN]
            d[a, b] = ((x[a] - y[b]) ** 2).sum(axis=1)
    return d


def _rough(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """What single precision needs for distances from x to y about y's mean: both sides, their squares; None if it can't hold them."""
    with np.errstate(over="ignore", invalid="ignore"):
        middle = y.mean(axis=0)
        fx, fy = (x - middle).astype(np.float32), (y - middle).astype(np.float32)
        xx, yy = (fx * fx).sum(axis=1), (fy * fy).sum(axis=1)
    # Under the square of the least normal number rounding isn't relative; far over it sums could overflow.
    fine = np.isfinite(xx).all() and np.isfinite(yy).all() and max(xx.max(), yy.max()) < 1e30 and max(xx.max(), yy.max()) > 1e-25
    return (fx, fy, xx, yy) if fine else None


def _near(x: Side, y: Side, skip_self: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, distances, slack a row) of a few left rows at a time against the right side.

    Distances are single-precision products; the true squared distance is within the slack. Where numbers are too large
    for that, distances are exact and the slack is 0. A frame's own is infinite if it is to be skipped, as are those
    that aren't numbers.
    """
    found = _rough(x.pixels, y.pixels)
    if found is not None:
        fx, fy, xx, yy = found
        slack = (8 * (fx.shape[1] + 16) * np.finfo(np.float32).eps) * (xx.astype(float) + float(yy.max()))
    low, high = np.searchsorted(y.ids, x.ids), np.searchsorted(y.ids, x.ids, side="right")
    for k in range(0, len(x.ids), _CHUNK):
        if found is None:
            with np.errstate(invalid="ignore", over="ignore"):
                d = _gaps(x.pixels[k : k + _CHUNK], y.pixels)
            d[~np.isfinite(d)] = np.inf
            least = np.zeros(len(d))
        else:
            d = fx[k : k + _CHUNK] @ fy.T
            d *= -2
            d += yy
            d += xx[k : k + _CHUNK, None]
            least = slack[k : k + _CHUNK]
        if skip_self:
            for row in np.flatnonzero(low[k : k + _CHUNK] < high[k : k + _CHUNK]):
                d[row, low[k + row] : high[k + row]] = np.inf
        yield k, d, least


def _exact(x: Side, y: Side, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of some pairs, term by term."""
    return np.concatenate([((x.pixels[r[k : k + _AGAIN]] - y.pixels[c[k : k + _AGAIN]]) ** 2).sum(axis=1) for k in range(0, len(r), _AGAIN)] or [np.zeros(0)])


def squared(left: DataFrame, right: DataFrame, block: int = WIDE) -> DataFrame:
    """(i, j, d2) of every pair of (frame, pixels) rows: the matrix itself, so its rows are the product of the sides."""
    return matrix(left, right, lambda x, y: _gaps(x.pixels, y.pixels), "d2", block)


def products(left: DataFrame, right: DataFrame, block: int = WIDE) -> DataFrame:
    """(i, j, value): inner products of every pair of (frame, pixels) rows."""
    return matrix(left, right, lambda x, y: _products(x.pixels, y.pixels), "value", block)


def matrix(left: DataFrame, right: DataFrame, measure: Callable[[Side, Side], np.ndarray], name: str = "value", block: int = WIDE, skip_self: bool = False) -> DataFrame:
    """(i, j, name) of every pair by a measure of some left rows against a block, given out as it is measured."""

    def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        for part in parts(x):
            i, j, d = np.repeat(part.ids, len(y.ids)), np.tile(y.ids, len(part.ids)), measure(part, y).ravel()
            there = i != j if skip_self else slice(None)
            yield pd.DataFrame({"i": i[there], "j": j[there], name: d[there]})

    return units(left, right, fold, f"i long, j long, {name} double", block)


def parts(side: Side, size: int = _CHUNK) -> Iterator[Side]:
    """A few rows of a side at a time."""
    for k in range(0, len(side.ids), size):
        part = Side.__new__(Side)
        part.ids, part.pixels, part.state = side.ids[k : k + size], side.pixels[k : k + size], side.state[k : k + size]
        part.squares = side.squares[k : k + size]
        yield part


def _candidates(x: Side, y: Side, k: int, skip_self: bool, known: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(left rows, right columns) of the pairs that may be among a left row's k nearest, some left rows at a time.

    ``known`` is the squared distance a row's k-th nearest has at most by other blocks. One product of matrices in single
    precision gives the distances less the row's own square; the k-th of the minima of groups of columns is no less than
    the k-th of all, and what is over it by more than the error's bound is out, group by group.
    """
    found = _rough(x.pixels, y.pixels)
    if found is None:
        for first, d, _ in _near(x, y, skip_self):
            kth = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
            r, c = np.nonzero((d <= np.minimum(kth, known[first : first + len(d)])[:, None]) & (d < np.inf))
            yield r + first, c
        return
    fx, fy, xx, yy = found
    slack = (8 * (fx.shape[1] + 16) * np.finfo(np.float32).eps) * (xx.astype(float) + float(yy.max()))
    group = GROUP if len(yy) >= 4 * GROUP * k else 1
    many = -(-len(yy) // group)
    sources = np.zeros((fx.shape[1] + 1, group * many), np.float32)
    sources[:-1, : len(yy)], sources[-1], sources[-1, : len(yy)] = fy.T, np.inf, yy
    low, high = (np.searchsorted(y.ids, x.ids, side=side) for side in ("left", "right"))
    cap = known - xx + 2 * slack
    for at in range(0, len(fx), 2 * _CHUNK):
        part = slice(at, at + 2 * _CHUNK)
        d = np.column_stack((-2 * fx[part], np.ones(len(fx[part]), np.float32))) @ sources
        if skip_self:
            for row in np.flatnonzero(low[part] < high[part]):
                d[row, low[at + row] : high[at + row]] = np.inf
        d = d.reshape(len(d), group, many)
        least = d.min(axis=1)
        kth = np.partition(least, k - 1, axis=1)[:, k - 1].astype(float) if k < many else np.full(len(d), np.inf)
        limit = np.minimum(np.minimum(kth + 2 * slack[part], cap[part]), 1e38)  # over all distances here, under infinity
        limit = np.nextafter(limit.astype(np.float32), np.float32(np.inf))
        r, g = np.nonzero(least <= limit[:, None])
        hit, level = np.nonzero(d[r, :, g] <= limit[r, None])
        yield r[hit] + at, level * many + g[hit]


def _best(row: np.ndarray, ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least (d, id) of each row, in order."""
    order = np.lexsort((ids, d, row))
    row, ids, d = row[order], ids[order], d[order]
    kept = (np.arange(len(row)) - np.searchsorted(row, row) < k) & (d < np.inf)
    return row[kept], ids[kept], d[kept]


def nearest(left: DataFrame, right: DataFrame, k: int, skip_self: bool = False, block: int = WIDE) -> DataFrame:
    """(frame, neighbour, rank, d2): the k nearest right rows of every left row, ties to the smaller frame.

    A left block meets a run of right blocks one after the other and keeps k rows a frame. Pairs are measured by products
    of matrices in single precision, and again, term by term in double precision, where they may be among a row's k
    nearest by the bound on the error, so the result is exact. What is shuffled grows with the blocks and not with the pairs.
    """
    n, m = _blocks(left.count(), right.count(), block)
    n = max(-(-n // TALL), min(n, SPREAD))
    runs = min(m, -(-2 * SPREAD**2 // n))
    kind, number = _kind(left, right), lambda c: F.pmod(F.xxhash64("frame"), F.lit(c)).cast("int")
    each = lambda c: F.explode(F.sequence(F.lit(0), F.lit(c - 1)))
    packed = ["ids", "flat", "state", "widths"]
    x = _packed(left, kind, number(n)).select(F.col("own").alias("a"), each(runs).alias("run"), F.lit(-1).alias("b"), *packed)
    y = _packed(right, kind, number(m)).select(each(n).alias("a"), F.pmod("own", F.lit(runs)).alias("run"), F.col("own").alias("b"), *packed)

    def given(x: Side, best: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
        return pd.DataFrame({"frame": x.ids[best[0]], "neighbour": best[1], "d2": best[2]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, x, best = None, None, None
        for batch in batches:
            for a, run, b, *side in zip(*(batch[c] for c in ("a", "run", "b", *packed)), strict=True):
                if (a, run) != at:
                    if best is not None:
                        yield given(x, best)
                    at, x, best = (a, run), None, None
                if b < 0:
                    x = Side(*side)
                    best = np.zeros(0, int), np.zeros(0, x.ids.dtype), np.zeros(0)
                elif x is not None:
                    y, known = Side(*side), np.full(len(x.ids), np.inf)
                    full = np.flatnonzero(np.bincount(best[0], minlength=len(x.ids)) == k)
                    known[full] = best[2][np.searchsorted(best[0], full, side="right") - 1]
                    parts = [best]
                    for r, c in _candidates(x, y, k, skip_self, known):
                        parts.append(_best(r, y.ids[c], _exact(x, y, r, c), k))
                    best = _best(*map(np.concatenate, zip(*parts, strict=True)), k)
        if best is not None:
            yield given(x, best)

    dealt = x.unionByName(y).repartition(min(TASKS, 2 * n * runs), "a", "run").sortWithinPartitions("a", "run", "b")
    found = dealt.mapInPandas(met, "frame long, neighbour long, d2 double")
    rank = F.row_number().over(W.partitionBy("frame").orderBy("d2", "neighbour"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("frame", "neighbour", "rank", "d2")


def nearest_flat(left: DataFrame, right: DataFrame) -> DataFrame:
    """(frame, neighbour, d2): the nearest right point of every left (frame, x, y) one, ties to the smaller frame.

    Points meet in cells of a grid that hold few of them, so pairs grow with the points. What lies within a cell's side of
    a point is in the nine cells about it, so a nearer find is the nearest; the rest look again in wider cells, and
    those that are still open meet all points, as do all where a cell would hold too many.
    """
    finite = "abs(x) < double('Infinity') AND abs(y) < double('Infinity')"
    places = settled(right.where(finite).groupBy("x", "y").agg(F.min("frame").alias("neighbour")))
    b = places.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xy"]).first()
    rest, out = settled(left.select("frame", "x", "y")), []
    if b["n"]:
        side = (b["x"] * b["y"] / b["n"]) ** 0.5 or max(b["x"], b["y"]) / b["n"] or 1.0
        for cell in (1.5 * side, 12 * side):
            at = [F.floor(F.col(c) / cell).alias(f"c{c}") for c in "xy"]
            held = places.select("neighbour", F.col("x").alias("ox"), F.col("y").alias("oy"), *at)
            if (held.groupBy("cx", "cy").count().agg(F.max("count")).first()[0] or 0) > CROWD:
                break
            about = F.explode(F.array(*[F.struct((F.floor(F.col("x") / cell) + i).alias("cx"), (F.floor(F.col("y") / cell) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
            met = rest.where(finite).withColumn("c", about).select("frame", "x", "y", "c.*").join(held, ["cx", "cy"])
            dx, dy = F.col("x") - F.col("ox"), F.col("y") - F.col("oy")
            best = met.groupBy("frame").agg(F.min(F.struct((dx * dx + dy * dy).alias("d2"), "neighbour")).alias("best"))
            found = settled(best.where(F.col("best.d2") <= (cell * (1 - 1e-6)) ** 2).select("frame", "best.neighbour", "best.d2"))
            out.append(found)
            rest = settled(rest.join(found.select("frame"), "frame", "left_anti"))
            if rest.isEmpty():
                break
    if not out or not rest.isEmpty():
        packed = lambda side, name: side.select(F.col(name).alias("frame"), F.array("x", "y").alias("pixels"))
        out.append(nearest(packed(rest, "frame"), packed(places, "neighbour"), 1).select("frame", "neighbour", "d2"))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def last_near(left: DataFrame, right: DataFrame, threshold: float, block: int = WIDE) -> DataFrame:
    """(frame, pick): the last other right frame nearer than the threshold, or -1; a unit gives one row a frame."""

    def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        for first, d, slack in _near(x, y, True):
            may = d <= (threshold**2 + slack)[:, None] * (1 + 1e-6)
            pick, open_ = np.full(len(d), -1, np.int64), np.flatnonzero(may.any(axis=1))
            while len(open_):  # the last that may be near enough, looked at exactly; else the one before
                c = may.shape[1] - 1 - may[open_, ::-1].argmax(axis=1)
                near = np.sqrt(_exact(x, y, open_ + first, c)) < threshold
                pick[open_[near]] = y.ids[c[near]]
                may[open_, c] = False
                open_ = open_[~near]
                open_ = open_[may[open_].any(axis=1)]
            there = pick >= 0
            yield pd.DataFrame({"frame": x.ids[first : first + len(d)][there], "pick": pick[there]})

    close = units(left, right, fold, "frame long, pick long", block).groupBy("frame").agg(F.max("pick").alias("pick"))
    return left.select("frame").join(close, "frame", "left").select("frame", F.coalesce("pick", F.lit(-1)).alias("pick"))


def jumps(frames: DataFrame, shortest: int, longest: int, each: int, block: int = 512) -> DataFrame:
    """(i, j, value): every frame's ``each`` nearest frames, ties to the smaller, of those over ``shortest`` and up to ``longest`` frames away.

    Blocks are ranges of frames that meet only those within reach, so pairs grow with the frames. A unit's best are given.
    """
    reach, kind = -(-longest // block), _kind(frames)
    packed = _packed(frames, kind, F.floor(F.col("frame") / block).cast("long"))
    x = packed.select(F.col("own").alias("a"), F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)).alias("b"), F.lit(0).alias("side"), "ids", "flat", "state", "widths")
    y = packed.select(F.explode(F.sequence(F.col("own") - reach, F.col("own") + reach)).alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), "ids", "flat", "state", "widths")

    def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        for part in parts(x):
            away = np.abs(part.ids[:, None] - y.ids[None])
            d = np.where((away > shortest) & (away <= longest), np.sqrt(_gaps(part.pixels, y.pixels)), np.inf)
            first = np.lexsort((np.broadcast_to(y.ids, d.shape), d))[:, :each]
            value, i = np.take_along_axis(d, first, 1).ravel(), np.repeat(part.ids, first.shape[1])
            there = np.isfinite(value)
            yield pd.DataFrame({"i": i[there], "j": y.ids[first].ravel()[there], "value": value[there]})

    return _folded(x.unionByName(y), fold, "i long, j long, value double", packed.count() * (2 * reach + 1))


def same(x: Side, y: Side) -> np.ndarray:
    """Where a row meets itself."""
    return x.ids[:, None] == y.ids[None]


def without(x: Side, y: Side, values: np.ndarray, other: float, reach: int = 0) -> np.ndarray:
    """Values of pairs, with another one where a row meets itself or one at most ``reach`` frames away."""
    low, high = np.searchsorted(y.ids, x.ids - reach), np.searchsorted(y.ids, x.ids + reach, side="right")
    for row in np.flatnonzero(low < high):
        values[row, low[row] : high[row]] = other
    return values


def between(x: Side, y: Side) -> np.ndarray:
    """Squared distances of some rows to others, as ``gaps`` gives them."""
    return _gaps_of(x.pixels, y.pixels, x.squares, y.squares)


def exact(x: Side, y: Side) -> np.ndarray:
    """Squared distances of some rows to a block, term by term."""
    return _gaps(x.pixels, y.pixels)


def lengths(x: Side, y: Side) -> np.ndarray:
    """Distances of some rows to a block."""
    return np.sqrt(between(x, y))


def summed(left: DataFrame, right: DataFrame, weigh: Callable[[Side, Side], np.ndarray], width: int, block: int = WIDE) -> DataFrame:
    """(frame, sums): for every left row its weights' sum over all right rows, then those of weight times each of ``width`` numbers in ``state``.

    A unit gives one row a frame, so no table of pairs is made.
    """

    def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        for part in parts(x):
            sums = np.zeros((len(part.ids), width + 1))
            for other in parts(y, TILE):
                w = weigh(part, other)
                sums[:, 0] += w.sum(axis=1)
                if width:
                    sums[:, 1:] += w @ other.state
            yield pd.DataFrame({"frame": part.ids, "sums": list(sums)})

    found = units(left, right, fold, "frame long, sums array<double>", block)
    return found.groupBy("frame").agg(F.array(*[F.sum(F.col("sums")[c]) for c in range(width + 1)]).alias("sums"))


def least(left: DataFrame, right: DataFrame, cost: Callable[[Side, Side], np.ndarray], block: int = WIDE) -> DataFrame:
    """(at, value): for every right row the least cost from any left row, infinite ones left out."""

    def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        best = np.full(len(y.ids), np.inf)
        for k, other in zip(range(0, len(y.ids), TILE), parts(y, TILE), strict=True):
            held = best[k : k + TILE]
            for part in parts(x):
                np.minimum(held, cost(part, other).min(axis=0), out=held)
        there = best < np.inf
        yield pd.DataFrame({"at": y.ids[there], "value": best[there]})

    return units(left, right, fold, "at long, value double", block).groupBy("at").agg(F.min("value").alias("value"))


def linked(frames: DataFrame, limit: float, block: int = WIDE) -> DataFrame:
    """Edges (a, b) that join just what pairs of (frame, pixels) rows at a squared distance of at most ``limit`` join.

    A unit's pairs that are in one group already aren't looked at again, and its groups are stars, so it gives no more edges than
    it has rows. What may be near by products of matrices is measured again term by term.
    """

    def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        n, ids = len(x.ids), np.concatenate((x.ids, y.ids))
        top, yy = np.arange(len(ids)), (y.pixels * y.pixels).sum(axis=1)
        for k, part in zip(range(0, n, _CHUNK), parts(x), strict=True):
            slack = 1e-9 * ((part.pixels * part.pixels).sum(axis=1)[:, None] + yy)
            own = top[k : k + len(part.ids)]
            r, c = np.nonzero((gaps(part.pixels, y.pixels) <= limit + slack) & (part.ids[:, None] < y.ids) & (own[:, None] != top[n:]))
            while len(r):
                a, b = r[:_LINKS], c[:_LINKS]
                near = _exact(part, y, a, b) <= limit
                top = united(len(ids), [(np.arange(len(ids)), top), (a[near] + k, b[near] + n)])
                r, c = r[_LINKS:], c[_LINKS:]
                apart = top[r + k] != top[c + n]
                r, c = r[apart], c[apart]
        moved = ids != ids[top]
        yield pd.DataFrame({"a": np.minimum(ids, ids[top])[moved], "b": np.maximum(ids, ids[top])[moved]})

    return units(frames, frames, fold, "a long, b long", block)


def diagonal_units(frames: DataFrame, size: int, n: int, fold: Callable[[np.ndarray, np.ndarray, np.ndarray], Iterator[pd.DataFrame]], schema: str, block: int = BLOCK) -> DataFrame:
    """What ``fold(i, j, value)`` gives for distances summed along the diagonal over +-size cells, indices mirrored at 0 and n - 1.

    Frames are numbers from 0 to n - 1. Blocks are ranges of them with ``size`` more at either end, so a unit has all that
    its sums read, and no pair of frames is shuffled. Frames that aren't there add nothing.
    """
    block = min(block, max(64, -(-n // SPREAD)))
    last, kind = max(0, (n - 1) // block), _kind(frames)
    f = F.col("frame")
    images = F.filter(F.array(f, F.when((f > 0) & (f <= size), -f), F.when((f < n - 1) & (2 * (n - 1) - f < n + size), 2 * (n - 1) - f)), lambda p: p.isNotNull())
    rows = frames.select(F.explode(images).alias("frame"), "pixels")
    own = F.explode(F.sequence(F.greatest(F.floor((F.col("frame") - size) / block), F.lit(0)), F.least(F.floor((F.col("frame") + size) / block), F.lit(last))))
    packed = _packed(rows.select("frame", "pixels", own.alias("own")), kind, F.col("own").cast("long"))
    each, rest = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))), ["ids", "flat", "state", "widths"]
    packed = packed.withColumn("state", F.array(F.col("own").cast("double")))
    x = packed.select(F.col("own").alias("a"), each.alias("b"), F.lit(0).alias("side"), *rest)
    y = packed.select(each.alias("a"), F.col("own").alias("b"), F.lit(1).alias("side"), *rest)

    def dense(side: Side) -> tuple[int, np.ndarray, np.ndarray]:
        """(first place, pixels of every place, whether it is there) of a block with its ends."""
        first = int(side.ids[0])
        there = np.zeros(int(side.ids[-1]) - first + 1, bool)
        there[side.ids - first] = True
        pixels = np.zeros((len(there), side.pixels.shape[1]))
        pixels[side.ids - first] = side.pixels
        return first, pixels, there

    def unit(x: Side, y: Side) -> Iterator[pd.DataFrame]:
        (i0, p, i_there), (j0, q, j_there) = dense(x), dense(y)
        j = j0 + np.arange(len(q))
        keep_j = j_there & (j >= 0) & (j < n) & (j // block == y.state[0, 0])
        for k in range(0, len(p), _CHUNK):
            low, high = max(0, k - size), min(len(p), k + _CHUNK + size)
            d = np.where(i_there[low:high, None] & j_there[None], np.sqrt(_gaps(p[low:high], q)), 0.0)
            i = i0 + np.arange(k, min(len(p), k + _CHUNK))
            out = np.zeros((len(i), len(q)))
            for step in range(-size, size + 1):
                r = np.arange(len(i)) + k - low + step
                rows = np.flatnonzero((r >= 0) & (r < len(d)))
                a, b = max(0, -step), min(len(q), len(q) - step)
                out[rows[:, None], np.arange(a, b)[None]] += d[r[rows], a + step : b + step]
            keep_i = i_there[i - i0] & (i >= 0) & (i < n) & (i // block == x.state[0, 0])
            if keep_i.any() and keep_j.any():
                yield from fold(i[keep_i], j[keep_j], out[np.ix_(keep_i, keep_j)])

    return _folded(x.unionByName(y), unit, schema, (last + 1) ** 2)


def diagonal_sums(frames: DataFrame, size: int, n: int, block: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(i, j, value): the distances of all pairs of frames, summed along the diagonal as ``diagonal_units`` does, and rounded if asked for."""

    def fold(i: np.ndarray, j: np.ndarray, value: np.ndarray) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"i": np.repeat(i, len(j)), "j": np.tile(j, len(i)), "value": (value if digits is None else np.round(value, digits)).ravel()})

    return diagonal_units(frames, size, n, fold, "i long, j long, value double", block)


def order_statistics(found: Callable[[Callable[[np.ndarray], dict], str], DataFrame], ranks: Callable[[int], list[int]]) -> tuple[list[float], float]:
    """(the values of given places in ascending order, the mean) of numbers that are only made again and again, never written.

    ``found(measure, schema)`` gives what ``measure`` says of each batch of numbers. Histograms narrow in on the bucket that a
    place lies in, and only its last few numbers are collected.
    """
    ends = found(lambda v: {"n": [len(v)], "low": [v.min()], "high": [v.max()], "total": [v.sum()]}, "n long, low double, high double, total double")
    n, least, most, total = ends.agg(F.sum("n"), F.min("low"), F.max("high"), F.sum("total")).first()
    out: dict[int, float] = {}
    for rank in ranks(n):
        low, high, inside, left = least, most, n, rank
        while high > low and inside > FEW:
            edges = np.linspace(low, high, BUCKETS + 1)

            def counted(v: np.ndarray, low=low, high=high, edges=edges) -> dict:
                v = np.sort(v[(v >= low) & (v <= high)])
                bucket = np.clip(np.searchsorted(edges, v, side="right") - 1, 0, BUCKETS - 1)
                name, first, size = np.unique(bucket, return_index=True, return_counts=True)
                return {"bucket": name, "n": size, "low": v[first], "high": v[first + size - 1]}

            cells = found(counted, "bucket long, n long, low double, high double").groupBy("bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            for r in cells.orderBy("bucket").collect():
                if left < r["n"]:
                    low, high, inside = r["low"], r["high"], r["n"]
                    break
                left -= r["n"]
        if high > low:
            rest = found(lambda v, low=low, high=high: {"v": v[(v >= low) & (v <= high)]}, "v double")
            out[rank] = sorted(r[0] for r in rest.collect())[left]
        else:
            out[rank] = low
    return [out[r] for r in ranks(n)], total / n


def median_length(frames: DataFrame) -> float:
    """The median distance over all pairs of (frame, pixels) rows, a frame with itself too; of two in the middle, their mean."""

    def found(measure: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
        def fold(x: Side, y: Side) -> Iterator[pd.DataFrame]:
            for part in parts(x):
                yield pd.DataFrame(measure(np.sqrt(gaps(part.pixels, y.pixels)).ravel()))

        return units(frames, frames, fold, schema)

    values, _ = order_statistics(found, lambda n: [(n - 1) // 2, n // 2])
    return sum(values) / 2


def mutual(matches: DataFrame) -> DataFrame:
    """(frame, neighbour) pairs that choose each other; pairs with frame 0 count too."""
    back = matches.select(F.col("neighbour").alias("frame"), F.col("frame").alias("neighbour"))
    return matches.select("frame", "neighbour").join(back, ["frame", "neighbour"])


def ratio_match(two: DataFrame, ratio: float = 0.6, compat: bool = False) -> DataFrame:
    """(frame, match, angle) from each frame's two nearest by angle: the best if it is under ``ratio`` of the second.

    Angles are acos(.9999 * dot) for unit vectors, so dot follows from the squared distance. Without a match, null; with
    ``compat``, 0 (which also stands for a match with frame 0).
    """
    angle = F.acos(0.9999 * (1 - F.col("d2") / 2))
    best = two.groupBy("frame").agg(
        F.min_by("neighbour", "rank").alias("best"), F.min(F.when(F.col("rank") == 1, angle)).alias("angle"), F.min(F.when(F.col("rank") == 2, angle)).alias("second"))
    match = F.when(F.col("angle") < ratio * F.col("second"), F.col("best"))
    return best.select("frame", (F.coalesce(match, F.lit(0)) if compat else match).alias("match"), "angle")


def inverse_distance(near: DataFrame, values: DataFrame) -> DataFrame:
    """(frame, value): the mean of the neighbours' values with weights 1 / d**6; an exact hit gives its own value."""
    weight = 1 / F.pow("d2", F.lit(3))
    joined = near.join(values.select(F.col("frame").alias("neighbour"), "value"), "neighbour")
    return joined.groupBy("frame").agg(
        F.coalesce(F.avg(F.when(F.col("d2") == 0, F.col("value"))), F.sum(F.when(F.col("d2") > 0, weight * F.col("value"))) / F.sum(F.when(F.col("d2") > 0, weight))).alias("value"))


def last_within(pairs: DataFrame, threshold: float, frames: DataFrame) -> DataFrame:
    """(frame, pick): the last other frame nearer than the threshold, or -1."""
    close = pairs.where((F.col("i") != F.col("j")) & (F.sqrt("d2") < threshold)).groupBy(F.col("i").alias("frame")).agg(F.max("j").alias("pick"))
    return frames.select("frame").join(close, "frame", "left").select("frame", F.coalesce("pick", F.lit(-1)).alias("pick"))


def _dealt(own: DataFrame, block: int, slice_rows: int) -> DataFrame:
    """(set, code, m, hot, x, i, j): every (set, member) row in its slice of members, once.

    A member of more than ``block`` sets is a slice of its own, whose rows are dealt into parts that meet two by two.
    """
    slices = max(1, -(-own.count() // slice_rows))
    rows = own.select("set", "member", F.xxhash64("member").alias("code"), F.pmod(F.xxhash64("member"), F.lit(slices)).cast("int").alias("m"))
    often = settled(own.groupBy("member").count().where(f"count > {block}").select("member", F.ceil(F.col("count") / block).cast("int").alias("parts")))
    if often.isEmpty():
        return rows.drop("member").withColumns({"hot": F.lit(0).cast("long"), "x": F.lit(0), "i": F.lit(0), "j": F.lit(0)})
    rows = rows.join(often, "member", "left").withColumns({"hot": F.when(F.col("parts") > 1, F.col("code")).otherwise(0), "parts": F.coalesce("parts", F.lit(1))})
    rows = rows.withColumn("x", F.pmod(F.xxhash64("set"), F.col("parts")).cast("int")).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select("set", "code", "m", "hot", "x", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))


def shared_counts(members: DataFrame, block: int = 2048, slice_rows: int = 1 << 18) -> DataFrame:
    """(a, b, both): for every two sets a < b of (set, member) rows that share members, how many.

    A row goes to its member's slice alone, which counts over its own members and gives a row a pair, or a few where it has
    many sets; so what is shuffled grows with the rows and the pairs that share a member, whatever the number of sets. A
    member of very many sets is dealt into parts that meet two by two, so it makes no unit larger than its share.
    """
    own = settled(members.select("set", "member").distinct())
    kind = dict(members.dtypes)["set"]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(batches))
        names, own = np.unique(part["set"].to_numpy(), return_inverse=True)
        order = np.argsort(part["code"].to_numpy(), kind="stable")
        code, own, half = part["code"].to_numpy()[order], own[order], part["x"].to_numpy()[order]
        across = part["i"].iloc[0] != part["j"].iloc[0]  # pairs inside one part belong to that part's own unit
        starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        sizes = np.diff(np.r_[starts, len(code)])
        at, sizes = np.repeat(starts, sizes), np.repeat(sizes, sizes)
        chunk = np.cumsum(sizes) // _PAIRS
        dense = np.zeros(len(names) ** 2, np.int64) if len(names) ** 2 <= _PAIRS else None

        def named(pairs: np.ndarray, both: np.ndarray) -> pd.DataFrame:
            return pd.DataFrame({"a": names[pairs // len(names)], "b": names[pairs % len(names)], "both": both})

        bounds = np.r_[np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]), len(code)]
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):  # each row against all of its member's
            size = sizes[low:high]
            step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            right = np.repeat(at[low:high], size) + step
            left = np.repeat(np.arange(low, high), size)
            met = own[left] < own[right]
            if across:
                met &= half[left] != half[right]
            pairs = own[left[met]] * len(names) + own[right[met]]
            if dense is not None:
                dense += np.bincount(pairs, minlength=len(dense))
            else:
                yield named(*np.unique(pairs, return_counts=True))
        if dense is not None:
            hit = np.flatnonzero(dense)
            yield named(hit, dense[hit])

    units = _dealt(own, block, slice_rows)
    return units.groupBy("m", "hot", "i", "j").applyInPandas(count, f"a {kind}, b {kind}, both long").groupBy("a", "b").agg(F.sum("both").alias("both"))


def overlap_normalised(members: DataFrame, values: DataFrame) -> DataFrame:
    """(a, b, distance) of sets that share a member: |value difference| over 2 shared / (|a| + |b| + .01) + .01.

    ``members`` are (set, member) rows and ``values`` (set, value). Sets that share nothing give no row. Sets' sizes and
    values, a row a set, are sent to all tasks if they are few, so that pairs are shuffled once.
    """
    sizes = members.select("set", "member").distinct().groupBy("set").agg(F.count("*").alias("n"))
    facts = settled(sizes.join(values, "set"))
    sent = F.broadcast if facts.count() <= SENT else lambda side: side
    of = lambda p: sent(facts.select(F.col("set").alias(p), F.col("n").alias(f"n_{p}"), F.col("value").alias(f"value_{p}")))
    overlap = 2 * F.col("both") / (F.col("n_a") + F.col("n_b") + 0.01) + 0.01
    return shared_counts(members).join(of("a"), "a").join(of("b"), "b").select("a", "b", (F.abs(F.col("value_a") - F.col("value_b")) / overlap).alias("distance"))


def shifted(a: DataFrame, b: DataFrame, shift: int, distance: Column) -> DataFrame:
    """Rows of a at t + shift against rows of b at t, both (key, t, ...): an equi-join on the shifted time."""
    moved = a.withColumn("t", F.col("t") - shift)
    return moved.alias("a").join(b.alias("b"), ["key", "t"]).select("key", "t", distance.alias("distance"))


def early_out(distances: DataFrame) -> DataFrame:
    """(key, t, distance) with every distance after a key's first zero set to 0."""
    before = W.partitionBy("key").orderBy("t").rowsBetween(W.unboundedPreceding, W.currentRow)
    stopped = F.max((F.col("distance") == 0).cast("int")).over(before)
    return distances.withColumn("distance", F.when(stopped == 1, 0.0).otherwise(F.col("distance")))
