"""Minimum cuts of pixel grids by push-relabel in tiles that exchange their borders, and the costs that the cuts take.

A tile holds its pixels' excess, labels (distances to the sink) and residual capacities, and the labels of the pixels
around it. In a sweep the tiles of one colour of a chessboard push their excess as far as they can while the others hold
still; what leaves a tile, and its new border labels, go to its neighbours. Between sweeps the exact distances come from
border exchanges alone, which also finds the excess that no sink can take any more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.session import settled, small_batches

#: Rows and columns of a tile, and units of capacity in one of cost: cuts are exact in whole units.
TILE, UNITS = (64, 64), 1_000_000
#: Cost of what isn't allowed, as in the chains.
FORBIDDEN = 1e7
#: A label that no sink answers to.
FAR = 1 << 40
#: Pushes between two exact relabellings of a tile.
PUSHES = 24
#: Bytes of tiles that Python gets at a time: some fifteen, as each takes several times its bytes there.
BYTES = 4 << 20

#: Sides of a tile: up, down, left, right; and the side that is opposite.
_SIDES, _OPPOSITE = ((-1, 0), (1, 0), (0, -1), (0, 1)), (1, 0, 3, 2)
_ARRAYS = ("excess", "sink", "up", "down", "left", "right", "label", "halo")
_STATE = "h int, w int, absorbed long, " + ", ".join(f"{c} array<long>" for c in _ARRAYS)
_STEP = f"state struct<{_STATE.replace(' int', ':int').replace(' long', ':long').replace(' array', ':array')}>, changed boolean, active boolean, messages array<struct<side:int,labels:array<long>,flow:array<long>>>"


class Tile:
    """One tile's numbers as arrays; ``caps`` and ``halo`` go by side."""

    def __init__(self, row: dict):
        self.h, self.w, self.absorbed = int(row["h"]), int(row["w"]), int(row["absorbed"])
        shaped = lambda c: np.array(row[c], np.int64).reshape(self.h, self.w)
        self.excess, self.sink, self.label = shaped("excess"), shaped("sink"), shaped("label")
        self.caps = [shaped(c) for c in ("up", "down", "left", "right")]
        at = np.cumsum([0, self.w, self.w, self.h, self.h])
        halo = np.array(row["halo"], np.int64)
        self.halo = [halo[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def state(self) -> tuple:
        arrays = (self.excess, self.sink, *self.caps, self.label)
        return (self.h, self.w, self.absorbed, *(x.ravel().tolist() for x in arrays), np.concatenate(self.halo).tolist())

    def edge(self, side: int) -> tuple:
        return (0, slice(None)) if side == 0 else (-1, slice(None)) if side == 1 else (slice(None), 0) if side == 2 else (slice(None), -1)

    def beyond(self, values: np.ndarray, side: int) -> np.ndarray:
        """Every pixel's neighbour's value on a side; around the tile it is the halo's."""
        out = np.empty_like(values)
        dy, dx = _SIDES[side]
        if dy:
            (out[1:] if dy < 0 else out[:-1])[...] = values[:-1] if dy < 0 else values[1:]
        else:
            (out[:, 1:] if dx < 0 else out[:, :-1])[...] = values[:, :-1] if dx < 0 else values[:, 1:]
        out[self.edge(side)] = self.halo[side]
        return out

    def distances(self) -> np.ndarray:
        """Least numbers of residual edges to the sink, through the tile and from the labels around it."""
        best = np.where(self.sink > 0, 1, FAR)
        open_ = [c > 0 for c in self.caps]
        while True:
            new = best
            for side in range(4):
                new = np.minimum(new, np.where(open_[side], self.beyond(new, side) + 1, FAR))
            if np.array_equal(new, best):
                return best
            best = new

    def discharge(self) -> list[np.ndarray]:
        """Push all excess that has a way; what leaves over each side."""
        gone = [np.zeros(len(x), np.int64) for x in self.halo]
        while True:
            self.label = np.maximum(self.label, self.distances())
            if not self.active():
                return gone
            for _ in range(PUSHES):
                self._push(gone)
                busy = (self.excess > 0) & (self.label < FAR)
                if not busy.any():
                    break
                least = np.where(self.sink > 0, 1, FAR)
                for side in range(4):
                    least = np.minimum(least, np.where(self.caps[side] > 0, self.beyond(self.label, side) + 1, FAR))
                self.label = np.where(busy, np.maximum(self.label, least), self.label)

    def _push(self, gone: list[np.ndarray]) -> None:
        flow = np.where(self.label < FAR, np.minimum(self.excess, self.sink), 0)
        self.absorbed += int(flow.sum())
        self.excess -= flow
        self.sink -= flow
        for side, (dy, dx) in enumerate(_SIDES):
            downhill = (self.label < FAR) & (self.label == self.beyond(self.label, side) + 1)
            flow = np.where(downhill, np.minimum(self.excess, self.caps[side]), 0)
            self.excess -= flow
            self.caps[side] -= flow
            gone[side] += flow[self.edge(side)]
            inner = flow.copy()
            inner[self.edge(side)] = 0
            moved = np.roll(inner, (dy, dx), (0, 1))
            self.excess += moved
            self.caps[_OPPOSITE[side]] += moved

    def take(self, messages) -> None:
        """What neighbours sent: the labels on their borders, and flow over the side."""
        for side, labels, flow in messages if messages is not None else ():
            self.halo[side] = np.array(labels, np.int64)
            if len(flow):
                flow = np.array(flow, np.int64)
                self.excess[self.edge(side)] += flow
                self.caps[side][self.edge(side)] += flow

    def active(self) -> bool:
        return bool(((self.excess > 0) & (self.label < FAR)).any())


def _worked(state: pd.DataFrame, messages: pd.Series, turn: pd.Series) -> pd.DataFrame:
    """One step of every tile of a batch. turn 0: takes messages; 1: the distances begin anew; 2: they go on; 3: discharge."""
    out = []
    for row, got, do in zip(state.to_dict("records"), messages, turn, strict=True):
        tile = Tile(row)
        tile.take([(m["side"], m["labels"], m["flow"]) for m in got] if got is not None else ())
        before, gone = [tile.label[tile.edge(s)].copy() for s in range(4)], None
        if do == 1:
            tile.halo = [np.full(len(x), FAR) for x in tile.halo]
            tile.label = tile.distances()
        elif do == 2:
            tile.label = tile.distances()
        elif do == 3:
            gone = tile.discharge()
        after = [tile.label[tile.edge(s)] for s in range(4)]
        changed = do == 1 or any(not np.array_equal(a, b) for a, b in zip(before, after, strict=True)) or gone is not None and any(x.any() for x in gone)
        sent = [(s, after[s].tolist(), gone[s].tolist() if gone is not None else []) for s in range(4)] if changed else []
        out.append((tile.state(), changed, tile.active(), sent))
    columns = pd.DataFrame(out, columns=["state", "changed", "active", "messages"])
    return columns.assign(state=[dict(zip(("h", "w", "absorbed", *_ARRAYS), s, strict=True)) for s in columns["state"]], messages=[[dict(zip(("side", "labels", "flow"), m, strict=True)) for m in ms] for ms in columns["messages"]])


_KEY = ["key", "ty", "tx"]


def _step(tiles: DataFrame, messages: DataFrame | None, turn: Column) -> DataFrame:
    """The tiles after a step, with what each sends; ``messages`` are those of the step before."""
    work = F.pandas_udf(lambda state, got, do: _worked(state, got, do), _STEP)
    if messages is None:
        given = tiles.withColumn("got", F.lit(None).cast("array<struct<side:int,labels:array<long>,flow:array<long>>>"))
    else:
        given = tiles.join(messages.groupBy(*_KEY).agg(F.collect_list("message").alias("got")), _KEY, "left")
    with small_batches(tiles.sparkSession, BYTES):
        return settled(given.select(*_KEY, work("state", "got", turn).alias("x")).select(*_KEY, "x.*"))


def _messages(tiles: DataFrame) -> DataFrame:
    """(key, ty, tx, message) for the tile that each message goes to, whose side is the opposite one."""
    sent = tiles.select(*_KEY, F.explode("messages").alias("m"))
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("m.side") + 1)
    to = (F.col("ty") + pick([s[0] for s in _SIDES])).alias("ty"), (F.col("tx") + pick([s[1] for s in _SIDES])).alias("tx")
    return sent.select("key", *to, F.struct(pick(_OPPOSITE).alias("side"), F.col("m.labels").alias("labels"), F.col("m.flow").alias("flow")).alias("message"))


def _tiles(pixels: DataFrame, tile: tuple[int, int]) -> DataFrame:
    """The tiles of (key, y, x, cost0, cost1, right, down), in whole units, with the base that every cut pays."""
    whole = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * UNITS).cast("long")
    cells = pixels.select("key", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *(whole(c).alias(c) for c in ("cost0", "cost1", "right", "down")))
    capacity = lambda dy, dx, c, name: cells.select("key", (F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.col(c).alias(name))
    there = cells.select("key", "y", "x", F.lit(1).alias("there"))
    # an edge is there if both its ends are
    for dy, dx, c, back in ((0, 1, "right", "left"), (1, 0, "down", "up")):
        other = there.select("key", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("there").alias(f"{c}_there"))
        cells = cells.join(other, ["key", "y", "x"], "left").withColumn(c, F.when(F.col(f"{c}_there").isNotNull(), F.col(c)).otherwise(0))
    for dy, dx, c, back in ((0, 1, "right", "left"), (1, 0, "down", "up")):
        cells = cells.join(capacity(dy, dx, c, back), ["key", "y", "x"], "left").withColumn(back, F.coalesce(back, F.lit(0)))
    th, tw = tile
    placed = cells.withColumns({"ty": F.floor(F.col("y") / th), "tx": F.floor(F.col("x") / tw)})
    cell = F.struct("y", "x", "cost0", "cost1", "up", "down", "left", "right")

    def packed(rows: pd.Series) -> pd.DataFrame:
        out = []
        for cells in rows:
            values = np.array([[c[n] for n in ("y", "x", "cost0", "cost1", "up", "down", "left", "right")] for c in cells], np.int64)
            y, x = values[:, 0] % th, values[:, 1] % tw
            table = np.zeros((6, th, tw), np.int64)
            table[:, y, x] = values[:, 2:].T
            cost0, cost1 = table[0], table[1]
            base = np.minimum(cost0, cost1)
            out.append((th, tw, 0, *(a.ravel().tolist() for a in (cost1 - base, cost0 - base, *table[2:])), np.zeros(th * tw, np.int64).tolist(), np.full(2 * (th + tw), FAR).tolist()))
        return pd.DataFrame(out, columns=["h", "w", "absorbed", *_ARRAYS])

    pack = F.pandas_udf(packed, _STATE)
    grouped = placed.groupBy("key", "ty", "tx").agg(F.collect_list(cell).alias("cells"))
    with small_batches(pixels.sparkSession, BYTES):
        return settled(grouped.select("key", "ty", "tx", pack("cells").alias("state")))


def min_cut(pixels: DataFrame, tile: tuple[int, int] = TILE) -> tuple[DataFrame, DataFrame]:
    """The labels (key, y, x, label) of least total cost, and the flow (key, flow) that proves it.

    ``pixels`` has (key, y, x, cost0, cost1, right, down): what label 0 and label 1 cost, and what unlike labels of the
    pixel and its right, or lower, neighbour cost; none is negative, null is 0. Any set of cells is allowed. The cut is
    the one with as many pixels as possible at label 0, so it doesn't depend on the order of the work; at costs in whole
    units of a millionth it is exact. A key's grid may have any size: what a task holds is one tile and its border.
    """
    cells = settled(pixels.select("key", "y", "x", "cost0", "cost1", "right", "down"))
    tiles = _tiles(cells, tile)
    colour = F.pmod(F.col("ty") + F.col("tx"), F.lit(2))
    while True:
        tiles = _step(tiles, None, F.lit(1))
        while not (going := tiles.where("changed")).isEmpty():
            tiles = _step(tiles, _messages(going), F.lit(2))
        if tiles.where("active").isEmpty():
            break
        for turn in (0, 1):
            pending = None if turn == 0 else _messages(tiles.where("changed"))
            tiles = _step(tiles, pending, F.when(colour == turn, 3).otherwise(0))
        tiles = _step(tiles, _messages(tiles.where("changed")), F.lit(0))
    th, tw = tile
    far = tiles.select(*_KEY, F.posexplode("state.label").alias("at", "away"))
    label = F.when(F.col("away") >= FAR, 0).otherwise(1)
    labels = far.select("key", (F.col("ty") * th + F.floor(F.col("at") / tw)).alias("y"), (F.col("tx") * tw + F.col("at") % tw).alias("x"), label.alias("label"))
    labels = settled(cells.select("key", F.col("y").cast("long"), F.col("x").cast("long")).join(labels, ["key", "y", "x"]))
    units = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * UNITS).cast("long")
    base = cells.groupBy("key").agg(F.sum(F.least(units("cost0"), units("cost1"))).alias("base"))
    flow = tiles.groupBy("key").agg(F.sum("state.absorbed").alias("absorbed")).join(base, "key")
    return labels, flow.select("key", ((F.col("absorbed") + F.col("base")) / UNITS).alias("flow"))


def cut_cost(pixels: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cost): what labels cost, in the units of ``min_cut``."""
    units = lambda c: F.round(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * UNITS).cast("long")
    own = pixels.select("key", "y", "x", *(units(c).alias(c) for c in ("cost0", "cost1", "right", "down"))).join(labels, ["key", "y", "x"])
    paid = F.when(F.col("label") == 0, F.col("cost0")).otherwise(F.col("cost1"))
    for dy, dx, c in ((0, 1, "right"), (1, 0, "down")):
        other = labels.select("key", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col("label").alias(f"{c}_label"))
        own = own.join(other, ["key", "y", "x"], "left")
        paid = paid + F.when(F.col("label") != F.col(f"{c}_label"), F.col(c)).otherwise(0)
    return own.groupBy("key").agg((F.sum(paid) / UNITS).alias("cost"))


def grid_pairs(pixels: DataFrame) -> DataFrame:
    """(key, y, x, side): the pairs of neighbouring pixels, each named by its left or upper one."""
    there = pixels.select("key", "y", "x")
    pairs = [there.join(there.select("key", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x")), ["key", "y", "x"], "left_semi").withColumn("side", F.lit(side)) for side, dy, dx in (("right", 0, 1), ("down", 1, 0))]
    return pairs[0].union(pairs[1])


def _with_neighbours(pixels: DataFrame, columns: list[str]) -> DataFrame:
    for side, dy, dx in (("r", 0, 1), ("d", 1, 0)):
        other = pixels.select("key", (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
        pixels = pixels.join(other, ["key", "y", "x"], "left")
    return pixels


def _norm(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def seam_costs(pixels: DataFrame, variance: float) -> DataFrame:
    """Costs of a seam between two patches, of (key, y, x, a, b, sure) with the patches' channels as arrays.

    Unlike labels at two neighbours cost half the squared gaps of the patches at both, over the variance: seams run where
    the patches agree. ``sure`` 0 or 1 fixes a pixel to that patch, null leaves it free; ``prior0`` and ``prior1``, if
    there, are added to the labels' costs.
    """
    gap = F.pow(_norm(F.col("a"), F.col("b")), 2) / (2 * variance)
    rows = _with_neighbours(pixels.withColumn("gap", gap), ["gap"])
    prior = lambda k: F.col(f"prior{k}") if f"prior{k}" in pixels.columns else F.lit(0.0)
    cost = lambda k: F.when(F.col("sure") == 1 - k, FORBIDDEN).when(F.col("sure") == k, 0.0).otherwise(prior(k))
    return rows.select("key", "y", "x", cost(0).alias("cost0"), cost(1).alias("cost1"), (F.col("gap") + F.col("r_gap")).alias("right"), (F.col("gap") + F.col("d_gap")).alias("down"))


def background_costs(pixels: DataFrame, low: float = 30 / 255, high: float = 60 / 255, contrast: float = 5 / 255, spread: float = 10 / 255) -> DataFrame:
    """Costs of foreground (1) against background (0), of (key, y, x, image, back) with channels as arrays.

    A pixel whose colour is at most ``low`` from the background's pays for foreground what it is nearer; between the
    two it pays for background what it is farther; over ``high`` it can't be background; at ``high`` itself both are
    free. Unlike neighbours pay less where the image has an edge, unless the background has the same one there.
    """
    rows = _with_neighbours(pixels.withColumn("away", _norm(F.col("image"), F.col("back"))), ["image", "back", "away"])
    step = lambda s: _norm(F.col("image"), F.col(f"{s}_image"))
    rows = rows.withColumns({"r_step": step("r"), "d_step": step("d")})
    mean = rows.groupBy("key").agg((F.sum(F.coalesce("r_step", F.lit(0.0)) + F.coalesce("d_step", F.lit(0.0))) / (F.count("r_step") + F.count("d_step"))).alias("mean_step"))
    rows = rows.join(mean, "key")

    def pair(s: str) -> Column:
        behind = _norm(F.col("back"), F.col(f"{s}_back"))
        off = F.greatest("away", f"{s}_away")
        damped = F.col(f"{s}_step") / (1 + F.pow(behind / contrast, 2) * F.exp(-off * off / spread))
        return F.when(F.col("mean_step") > 0, F.exp(-2.0 * damped / F.col("mean_step"))).otherwise(1.0)

    away = F.col("away")
    cost1 = F.when(away <= low, low - away).otherwise(0.0)
    cost0 = F.when(away > high, FORBIDDEN).when((away > low) & (away < high), away - low).otherwise(0.0)
    held = lambda s: F.when(F.col(f"{s}_step").isNotNull(), pair(s))
    return rows.select("key", "y", "x", cost0.alias("cost0"), cost1.alias("cost1"), held("r").alias("right"), held("d").alias("down"))
