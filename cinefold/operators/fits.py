"""Damped least squares: thousands of small problems solved together in Arrow batches; long ones by sums over their pieces.

The problem solved here is a box volume that moves along a track and should fill the boxes in which a camera saw it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.session import settled

#: A volume's parameters, in order: its size, where and how it starts, and how the track is stretched.
PARAMETERS = ("width", "length", "height", "x", "y", "turn", "stretch_x", "stretch_y")
#: Corners of the unit volume: (length, width, height).
_UNIT = np.array([(a, b, c) for c in (0.0, 1.0) for a, b in ((-0.5, -0.5), (-0.5, 0.5), (0.5, 0.5), (0.5, -0.5))])
#: The width and height that the prior expects for a length of one.
WIDE, HIGH = 0.43, 0.36
#: Rows of a track solved in one piece, rows in numpy at a time, and the first damping.
LONG, TOGETHER, DAMPING = 4096, 1 << 13, 1e-3
_SEEN = ["x", "y", "turn", "left", "top", "right", "bottom"]


def box_residuals(parameters: np.ndarray, first_turn: np.ndarray, seen: np.ndarray, camera: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, slopes) of n rows: the four sides of the projected volume's extent less those of the box it was seen in.

    ``parameters`` is (n, 8), each row's own; ``seen`` is (n, 7): the track's place and turn, then left, top, right, bottom.
    The track's places are turned by how far the volume's turn has come from ``first_turn``, and stretched. ``camera`` is a
    3 x 4 projection. A side's slope is that of the corner that makes it.
    """
    wide, long, high, px, py, turn, sx, sy = parameters.T[:, :, None]
    x, y, relative = seen[:, :3].T[:, :, None]
    a, b, c = _UNIT.T
    cos, sin = np.cos(turn + relative), np.sin(turn + relative)
    back = turn - first_turn[:, None]
    along, across = np.cos(back) * x + np.sin(back) * y, np.cos(back) * y - np.sin(back) * x
    u, v = a * long, b * wide
    place = cos * u + sin * v + (px + along * sx), cos * v - sin * u + (py + across * sy), c * high
    image = [sum(m * p for m, p in zip(r, place, strict=False)) + r[3] for r in camera]
    flat = [image[k] / image[2] for k in (0, 1)]
    pick = np.stack([f(flat[k], axis=1) for f in (np.argmin, np.argmax) for k in (0, 1)], axis=1)  # left, top, right, bottom
    axis, row = np.array([0, 1, 0, 1]), np.arange(len(seen))[:, None]
    side = np.stack([flat[k][row[:, 0], pick[:, n]] for n, k in enumerate(axis)], axis=1)
    # how a side follows its corner's place, then how that follows the parameters
    gx, gy, gz = ((camera[axis, k] - side * camera[2, k]) / image[2][row, pick] for k in range(3))
    a, b, c = a[pick], b[pick], c[pick]
    u, v = a * long, b * wide
    turned = gx * (cos * v - sin * u + across * sx) - gy * (cos * u + sin * v + along * sy)
    return side - seen[:, 3:], np.stack((b * (gx * sin + gy * cos), a * (gx * cos - gy * sin), gz * c, gx, gy, turned, gx * along, gy * across), axis=2)


def shape_residuals(parameters: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """(residuals, slopes) of the prior: how far width and height are from their shares of the length."""
    wide, long, high = parameters[:, 0], parameters[:, 1], parameters[:, 2]
    slopes, root = np.zeros((len(parameters), 2, 8)), np.sqrt(weight / 2)
    for k, (size, share) in enumerate(((wide, WIDE), (high, HIGH))):
        slopes[:, k, 2 * k], slopes[:, k, 1] = root / long, -root * size / long**2
    return root * np.column_stack((wide / long - WIDE, high / long - HIGH)), slopes


def summed(residuals: np.ndarray, slopes: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """(count, 1 + p + p p): each problem's cost, slope and curvature, from rows that name their problem, one after the other."""
    cost = (residuals**2).sum(axis=1)[:, None]
    slope = np.einsum("nr,nrp->np", residuals, slopes)
    curve = np.matmul(slopes.transpose(0, 2, 1), slopes).reshape(len(slopes), -1)
    out = np.zeros((count, 1 + slope.shape[1] + curve.shape[1]))
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    out[owner[starts]] = np.add.reduceat(np.hstack((cost, slope, curve)), starts, axis=0)
    return out


@dataclass
class Descent:
    """Where each problem is, the sums there, its damping, the place tried next, and whether it has ended."""

    at: np.ndarray
    sums: np.ndarray
    damping: np.ndarray
    trial: np.ndarray
    done: np.ndarray

    @classmethod
    def begun(cls, start: np.ndarray) -> Descent:
        n, p = start.shape
        return cls(start.copy(), np.full((n, 1 + p + p * p), np.inf), np.full(n, DAMPING), start.copy(), np.zeros(n, bool))

    def of(self, some: np.ndarray) -> Descent:
        return Descent(*(getattr(self, f.name)[some] for f in fields(self)))

    def put(self, some: np.ndarray, other: Descent) -> None:
        for f in fields(self):
            getattr(self, f.name)[some] = getattr(other, f.name)

    def advance(self, sums: np.ndarray, free: np.ndarray, tolerance: float) -> None:
        """Takes the trials that lower the cost, damps the others more, and sets the next trials (Levenberg and Marquardt).

        A problem has ended when its next step is under the tolerance, relative to where it is, or its damping has outgrown all use.
        """
        p = self.at.shape[1]
        better = ~self.done & (sums[:, 0] < self.sums[:, 0])
        self.at[better], self.sums[better] = self.trial[better], sums[better]
        self.damping = np.where(self.done, self.damping, np.where(better, self.damping / 5, self.damping * 4))
        lost = ~np.isfinite(self.sums[:, 0])
        held = np.where(np.isfinite(self.sums), self.sums, 0.0)
        slope, curve = held[:, 1 : 1 + p] * free, held[:, 1 + p :].reshape(-1, p, p) * np.outer(free, free)
        scale = np.einsum("npp->np", curve)
        ridge = self.damping[:, None] * scale + 1e-12 * scale.max(axis=1, initial=0, keepdims=True) + ~free + (scale == 0)
        step = np.linalg.solve(curve + ridge[:, :, None] * np.eye(p), slope[:, :, None])[:, :, 0]
        self.trial = np.where(self.done[:, None], self.at, self.at - step)
        small = (np.abs(step) <= tolerance * (1 + np.abs(self.at))).all(axis=1)
        self.done |= lost | small | (self.damping > 1e12)


def minimised(start: np.ndarray, sums: Callable[[np.ndarray, np.ndarray], np.ndarray], free: np.ndarray, rounds: int, tolerance: float) -> Descent:
    """Problems whose sums one function gives together, for the trials and numbers of those that haven't ended."""
    state = Descent.begun(start)
    for _ in range(rounds):
        live = np.flatnonzero(~state.done)
        if not len(live):
            break
        going = state if len(live) == len(start) else state.of(live)
        going.advance(sums(going.trial, live), free, tolerance)
        if going is not state:
            state.put(live, going)
    return state


def _piece_sums(trial: np.ndarray, first: np.ndarray, rows: np.ndarray, owner: np.ndarray, camera: np.ndarray, free: np.ndarray) -> np.ndarray:
    """The sums of each piece's boxes over the parameters that are free, some thousand rows at a time; rows stand piece by piece."""
    p = free.sum()
    out = np.zeros((len(trial), 1 + p + p * p))
    for k in range(0, len(rows), TOGETHER):
        own = owner[k : k + TOGETHER]
        low = own[0]
        residuals, slopes = box_residuals(trial[own], first[own], rows[k : k + TOGETHER], camera)
        out[low : own[-1] + 1] += summed(residuals, slopes[:, :, free], own - low, own[-1] + 1 - low)
    return out


def _solved(begin: np.ndarray, rows: np.ndarray, owner: np.ndarray, camera: np.ndarray, free: np.ndarray, prior: float, rounds: int, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(parameters, cost) of many problems at once; held parameters stay out of the steps."""

    def sums(trial: np.ndarray, live: np.ndarray) -> np.ndarray:
        at = begin[live]
        at[:, free] = trial
        if len(live) == len(begin):
            mine, own = rows, owner
        else:
            number = np.full(len(begin), -1)
            number[live] = np.arange(len(live))
            there = number[owner] >= 0
            mine, own = rows[there], number[owner[there]]
        found = _piece_sums(at, begin[live, 5], mine, own, camera, free)
        return found + _prior_sums(at, prior, free) if prior else found

    state = minimised(begin[:, free], sums, np.ones(free.sum(), bool), rounds, tolerance)
    at = begin.copy()
    at[:, free] = state.at
    return at, state.sums[:, 0]


def _prior_sums(trial: np.ndarray, weight: float, free: np.ndarray) -> np.ndarray:
    residuals, slopes = shape_residuals(trial, weight)
    return summed(residuals, slopes[:, :, free], np.arange(len(trial)), len(trial))


def refined(rows: DataFrame, camera: np.ndarray, keep: list[str], held: tuple[str, ...] = (), prior: float = 0.0, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """(``keep``, fit, cost): ``fitted`` where every row is a problem of its own, which brings its start along.

    ``rows`` are (x, y, turn, left, top, right, bottom, start) beside the columns to be kept. Rows with a null are left out;
    nothing is shuffled.
    """
    camera, free = np.asarray(camera, float), np.array([n not in held for n in PARAMETERS])
    seen = [f"_{c}" for c in _SEEN]
    wanted = rows.select(*keep, F.col("start").cast("array<double>").alias("_start"), *[F.col(c).cast("double").alias(f"_{c}") for c in _SEEN])

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch[batch[["_start", *seen]].notna().all(axis=1)]  # here, as a filter below would work all boxes out twice
            if len(batch):
                at, cost = _solved(np.stack(batch["_start"].to_numpy()).astype(float), batch[seen].to_numpy(float), np.arange(len(batch)), camera, free, prior, rounds, tolerance)
                yield batch[keep].assign(fit=list(at), cost=cost)

    kinds = dict(wanted.dtypes)
    return wanted.mapInPandas(solved, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "fit array<double>", "cost double"]))


def fitted(observed: DataFrame, start: DataFrame, camera: np.ndarray, held: tuple[str, ...] = (), prior: float = 0.0, rounds: int = 200, tolerance: float = 1e-9, long: int = LONG) -> DataFrame:
    """(key, fit, cost): for each key the parameters (see ``PARAMETERS``) at which its volume fills its boxes best.

    ``observed`` are (key, x, y, turn, left, top, right, bottom): the track and the boxes seen along it; rows with a null are
    left out, and keys without a row or a start give none. ``start`` is (key, start). Parameters in ``held`` stay as they
    start: with the height held at 0 this fits a footprint, with all but place and turn held and a key for every row it
    refines single frames. The cost is the sum of squared differences of the boxes' sides, in the camera's units, plus
    ``prior`` times half the squared differences of width and height from their shares of the length. ``rounds`` bounds
    the steps; what it cuts short is returned as it is then.

    A key of at most ``long`` rows is solved where its rows are, many at once in numpy. A longer one is dealt into
    pieces: every round each piece gives its sums, 73 numbers, which are added up by key before the next step.
    """
    camera, free = np.asarray(camera, float), np.array([n not in held for n in PARAMETERS])
    key = dict(observed.dtypes)["key"]
    rows = settled(observed.select("key", *[F.col(c).cast("double").alias(c) for c in _SEEN])).dropna()
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).join(start.select("key", F.col("start").cast("array<double>").alias("start")), "key")
    rows = rows.join(sizes, "key").withColumn("piece", F.pmod(F.xxhash64(*_SEEN), F.ceil(F.col("n") / long)))
    # rows that are alike go to one piece, which bounds it only by how often a row is repeated
    # so many partitions as named, as the work of a row is far beyond its size
    rows = rows.repartition(int(observed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key", "piece")
    pieces = settled(rows.groupBy("key", "piece", "n", "start").agg(F.flatten(F.collect_list(F.array(*_SEEN))).alias("seen")))

    def tracks(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """All boxes of a batch and the number of the piece that each belongs to."""
        seen = [np.asarray(s, float).reshape(-1, len(_SEEN)) for s in batch["seen"]]
        return np.concatenate(seen), np.repeat(np.arange(len(seen)), [len(s) for s in seen])

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, cost = _solved(np.array(batch["start"].tolist(), float), *tracks(batch), camera, free, prior, rounds, tolerance)
                yield pd.DataFrame({"key": batch["key"], "fit": list(at), "cost": cost})

    out = f"key {key}, fit array<double>, cost double"
    short = pieces.where(F.col("n") <= long).select("key", "start", "seen").mapInPandas(solved, out)
    parts = pieces.where(F.col("n") > long)
    if parts.isEmpty():
        return short
    return short.unionByName(_by_pieces(parts, key, tracks, camera, free, prior, rounds, tolerance))


def _by_pieces(parts: DataFrame, key: str, tracks: Callable, camera: np.ndarray, free: np.ndarray, prior: float, rounds: int, tolerance: float) -> DataFrame:
    """(key, fit, cost) of keys in several pieces; a key's state is one row, settled every round."""
    kept = ("at", "sums", "trial")
    width, every = 1 + len(PARAMETERS) + len(PARAMETERS) ** 2, np.ones(len(PARAMETERS), bool)
    kinds = "first double, at array<double>, sums array<double>, damping double, trial array<double>, done boolean"

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                begin = np.array(batch["start"].tolist(), float)
                yield packed(batch["key"], begin[:, 5], Descent.begun(begin))

    def packed(keys: pd.Series, first: np.ndarray, s: Descent) -> pd.DataFrame:
        return pd.DataFrame({"key": keys, "first": first, "at": list(s.at), "sums": list(s.sums), "damping": s.damping, "trial": list(s.trial), "done": s.done})

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"key": batch["key"], "part": list(_piece_sums(np.array(batch["trial"].tolist(), float), batch["first"].to_numpy(), *tracks(batch), camera, every))})

    def stepped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, sums, trial = (np.array(batch[c].tolist(), float) for c in kept)
                state = Descent(at, sums, batch["damping"].to_numpy(float), trial, batch["done"].to_numpy(bool).copy())
                state.advance(np.array(batch["total"].tolist(), float) + _prior_sums(trial, prior, every), free, tolerance)
                yield packed(batch["key"], batch["first"].to_numpy(), state)

    states = settled(parts.select("key", "start").distinct().mapInPandas(begun, f"key {key}, {kinds}"))
    ended = []
    for _ in range(rounds):
        part = parts.select("key", "seen").join(states.select("key", "first", "trial"), "key").mapInPandas(measured, f"key {key}, part array<double>")
        total = part.groupBy("key").agg(F.array(*[F.sum(F.col("part")[i]) for i in range(width)]).alias("total"))
        states = settled(states.join(total, "key").mapInPandas(stepped, f"key {key}, {kinds}"))
        ended.append(states.where("done"))
        states = states.where("not done")
        if states.isEmpty():
            break
    whole = states
    for some in ended:
        whole = whole.unionByName(some)
    return whole.select("key", F.col("at").alias("fit"), F.col("sums")[0].alias("cost"))
