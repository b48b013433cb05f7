"""Joint paths of several instances by dual decomposition into trees, with a lower bound on the least energy.

The graph has a chain over time for every instance and, at every time, an edge between every two instances. Its trees are
the whole chains and the single edges. Multipliers move costs between a chain and the edges that stand on it; the sum of
the trees' least costs is a bound on the least energy whatever they are, and rounds of subgradient steps raise it. The
labels that the chains agree on are paths, of which the best is kept.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.operators.inference import BLOCK, _labels, _through, greedy
from cinefold.session import settled

#: Rounds of steps at most, the gap between energy and bound at which a key is done, and what a step shrinks by when the
#: bound hasn't risen.
ROUNDS, GAP, SHRINK = 80, 1e-6, 0.9
#: Times of graphs that take their rounds together.
TOGETHER = 1 << 14


def _pairs(instances: int) -> list[tuple[int, int]]:
    return list(itertools.combinations(range(instances), 2))


def _moved(costs: np.ndarray, given: np.ndarray) -> np.ndarray:
    """The chains' costs (instance, time, label) with what the edges' multipliers (pair, end, time, label) add."""
    out = costs.copy()
    for p, ends in enumerate(_pairs(len(costs))):
        for side, i in enumerate(ends):
            out[i] += given[p, side]
    return out


def _edges(given: np.ndarray, clash: np.ndarray) -> tuple[float, np.ndarray]:
    """The least costs of all edges, summed, and the labels (pair, end, time) that have them."""
    k = len(clash)
    left = clash[None, None] - given[:, 0, :, :, None] - given[:, 1, :, None, :]
    flat = left.reshape(*left.shape[:2], k * k)
    at = flat.argmin(axis=2)
    return float(flat.min(axis=2).sum()), np.stack((at // k, at % k), axis=1)


def _slopes(labels: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """The bound's slope along each multiplier: the chain's label less the edge's."""
    eye = np.eye(k)
    chosen = np.stack([np.stack([labels[i] for i in pair]) for pair in _pairs(len(labels))]) if len(labels) > 1 else np.zeros((0, 2, labels.shape[1]), int)
    return eye[chosen] - eye[ends]


def _energy(costs: np.ndarray, labels: np.ndarray, move: np.ndarray, clash: np.ndarray, before: np.ndarray | None = None) -> float:
    """What labels (instance, time) cost, with the moves from the labels before the first time, if there are any."""
    out = 0.0
    for i, own in enumerate(labels):
        out += costs[i, np.arange(len(own)), own].sum() + move[own[:-1], own[1:]].sum()
        if before is not None and before[i] >= 0:
            out += move[before[i], own[0]]
    return out + sum(clash[labels[i], labels[j]].sum() for i, j in _pairs(len(labels)))


def _paths(costs: np.ndarray, move: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least costs (graph, instance) of all chains (graph, instance, time, label), and their first labels; a chain ends
    where its times are no more ``there``."""
    best, back, k = costs[:, :, 0], [], len(move)
    for t in range(1, costs.shape[2]):
        step, on = best[..., None] + move, there[:, None, t, None]
        back.append(np.where(on, step.argmin(axis=2), np.arange(k)))
        best = np.where(on, step.min(axis=2) + costs[:, :, t], best)
    labels = np.empty(costs.shape[:3], int)
    labels[:, :, -1] = best.argmin(axis=2)
    for t in range(len(back) - 1, -1, -1):
        labels[:, :, t] = np.take_along_axis(back[t], labels[:, :, t + 1, None], 2)[..., 0]
    return best.min(axis=2), labels


def _step(step: float, best: float, dual: float, bound: float, square: float) -> tuple[float, float]:
    """(the next size of steps, how far to go along the slopes)."""
    step = step if dual > bound + 1e-9 else step * SHRINK
    return step, step * (best - dual + GAP) / square if square else 0.0


def solved(costs: list[np.ndarray], start: list[np.ndarray], move: np.ndarray, clash: np.ndarray, rounds: int) -> list[tuple[np.ndarray, float, float]]:
    """(labels, energy, bound) of every graph (instance, time, label) that a task holds; ``start`` are labels to be improved on.

    Graphs of about equal length take their rounds together, time by time, until each is done.
    """
    out: list = [None] * len(costs)
    waiting = sorted(range(len(costs)), key=lambda g: -costs[g].shape[1])
    while waiting:
        some = waiting[: max(1, TOGETHER // costs[waiting[0]].shape[1])]
        waiting = waiting[len(some) :]
        for g, found in zip(some, _together([costs[g] for g in some], [start[g] for g in some], move, clash, rounds), strict=True):
            out[g] = found
    return out


def _together(costs: list[np.ndarray], start: list[np.ndarray], move: np.ndarray, clash: np.ndarray, rounds: int) -> list[tuple[np.ndarray, float, float]]:
    (n, _, k), sizes = costs[0].shape, np.array([c.shape[1] for c in costs])
    pairs, eye = _pairs(n), np.eye(k)
    own = np.zeros((len(costs), n, sizes.max(), k))
    for g, c in enumerate(costs):
        own[g, :, : c.shape[1]] = c
    at, there = np.arange(len(costs)), np.arange(sizes.max()) < sizes[:, None]
    given = np.zeros((len(costs), len(pairs), 2, sizes.max(), k))
    found, bound = list(start), np.full(len(costs), -np.inf)
    best, step = np.array([_energy(c, s, move, clash) for c, s in zip(costs, start, strict=True)]), np.ones(len(costs))
    for _ in range(rounds):
        moved, both = own.copy(), there[:, 1:] & there[:, :-1]
        for p, ends in enumerate(pairs):
            for side, i in enumerate(ends):
                moved[:, i] += given[:, p, side]
        least, labels = _paths(moved, move, there)
        left = (clash - given[:, :, 0, :, :, None] - given[:, :, 1, :, None, :]).reshape(*given.shape[:2], given.shape[3], k * k)
        pick = left.argmin(axis=3)
        dual = least.sum(axis=1) + (left.min(axis=3) * there[:, None]).sum(axis=(1, 2))
        energy = (np.take_along_axis(own, labels[..., None], 3)[..., 0] * there[:, None]).sum(axis=(1, 2))
        energy = energy + (move[labels[:, :, :-1], labels[:, :, 1:]] * both[:, None]).sum(axis=(1, 2))
        for i, j in pairs:
            energy = energy + (clash[labels[:, i], labels[:, j]] * there).sum(axis=1)
        for g in np.flatnonzero(energy < best[at]):
            found[at[g]], best[at[g]] = labels[g, :, : sizes[at[g]]], energy[g]
        slopes = np.zeros_like(given)
        for p, ends in enumerate(pairs):
            for side, (i, mine) in enumerate(zip(ends, (pick[:, p] // k, pick[:, p] % k), strict=True)):
                slopes[:, p, side] = (eye[labels[:, i]] - eye[mine]) * there[..., None]
        square, far = (slopes**2).sum(axis=(1, 2, 3, 4)), np.zeros(len(at))
        for g, a in enumerate(at):
            step[a], far[g] = _step(step[a], best[a], dual[g], bound[a], square[g])
        bound[at] = np.maximum(bound[at], dual)
        on = (best[at] - bound[at] > GAP) & (far != 0)
        if not on.any():
            break
        given = given[on] + far[on, None, None, None, None] * slopes[on]
        at, own, there = at[on], own[on], there[on]
    return [(found[g], float(best[g]), float(bound[g])) for g in range(len(costs))]


def _shaped(row: dict, instances: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    costs = np.asarray(row["costs"], float).reshape(instances, -1, k)
    return costs, np.asarray(row["given"], float).reshape(len(_pairs(instances)), 2, costs.shape[1], k)


def joint(instances: list[DataFrame], moves: list[list[float]], clash: list[list[float]], a: float, b: float, rounds: int = ROUNDS, block: int = BLOCK) -> DataFrame:
    """(key, t, labels, energy, bound): paths of all instances together, their cost, and what no paths can be below.

    Instances are (key, t, costs) over the same keys and times, dense from 0. The energy is a * unary + (1 - a) * b *
    clash between every two instances at a time + (1 - a) * (1 - b) * move, all of them summed. It is never above that
    of ``inference.greedy``, whose paths are the start; with one instance it is the least, and so is the bound. Moves
    must be finite. A key of at most ``block`` times is solved in its task; longer ones in blocks, all keys at once: the
    chains of a round are folded from the blocks as in ``inference.viterbi``, and no task holds more than one of them or
    a key's block ends.
    """
    n, move, against = len(instances), (1 - a) * (1 - b) * np.array(moves, float), (1 - a) * b * np.array(clash, float)
    k = len(move)
    first = greedy(instances, moves, clash, a, b)
    rows = instances[0].select("key", "t", F.array(F.transform("costs", lambda x: a * x)).alias("costs"))
    for other in instances[1:]:
        own = other.select("key", "t", F.transform("costs", lambda x: a * x).alias("_own"))
        rows = rows.join(own, ["key", "t"]).select("key", "t", F.concat("costs", F.array("_own")).alias("costs"))
    rows = rows.withColumn("start", F.array().cast("array<int>"))
    for path in first:
        rows = rows.join(path.select("key", "t", F.col("label").cast("int").alias("_own")), ["key", "t"]).select("key", "t", "costs", F.concat("start", F.array("_own")).alias("start"))
    packed = rows.groupBy("key", F.floor(F.col("t") / block).cast("long").alias("b")).agg(F.array_sort(F.collect_list(F.struct("t", "costs", "start"))).alias("rows"))
    # time by time; a task turns them round
    packed = settled(packed.select("key", "b", F.col("rows.t").alias("t"), F.flatten(F.flatten("rows.costs")).alias("costs"), F.flatten("rows.start").alias("start")))
    long_ = settled(packed.where("b > 0").select("key").distinct())

    @F.pandas_udf("labels array<int>, energy double, bound double")
    def whole(costs: pd.Series, start: pd.Series) -> pd.DataFrame:
        tables = [np.asarray(c, float).reshape(-1, n, k).transpose(1, 0, 2) for c in costs]
        found = solved(tables, [np.asarray(s, int).reshape(-1, n).T for s in start], move, against, rounds)
        return pd.DataFrame([(labels.T.ravel().tolist(), energy, bound) for labels, energy, bound in found], columns=["labels", "energy", "bound"])

    def spread(frame: DataFrame) -> DataFrame:
        """(key, t, labels, energy, bound) of blocks whose labels stand time by time."""
        at = frame.select("key", "t", "labels", "energy", "bound", F.explode(F.sequence(F.lit(0), F.size("t") - 1)).alias("at"))
        return at.select("key", F.col("t")[F.col("at")].cast("long").alias("t"), F.slice("labels", F.col("at") * n + 1, F.lit(n)).alias("labels"), "energy", "bound")

    short = packed.join(long_, "key", "left_anti").select("key", "t", whole("costs", "start").alias("x")).select("key", "t", "x.*")
    if long_.isEmpty():
        return spread(short)
    return spread(short).union(spread(_in_blocks(packed.join(long_, "key", "left_semi"), n, move, against, rounds)))


def _in_blocks(packed: DataFrame, n: int, move: np.ndarray, clash: np.ndarray, rounds: int) -> DataFrame:
    """(key, t, labels, energy, bound) of every block of long keys."""
    k, pairs = len(move), len(_pairs(n))

    @F.pandas_udf("costs array<double>, given array<double>, labels array<int>")
    def begun(costs: pd.Series, start: pd.Series) -> pd.DataFrame:
        tables = [np.asarray(c, float).reshape(-1, n, k).transpose(1, 0, 2) for c in costs]
        return pd.DataFrame({"costs": [x.ravel() for x in tables], "given": [np.zeros(pairs * 2 * x.shape[1] * k) for x in tables], "labels": [np.asarray(s, int).reshape(-1, n).T.ravel() for s in start]})

    @F.pandas_udf("array<double>")
    def through(b: pd.Series, costs: pd.Series, given: pd.Series) -> pd.Series:
        out = []
        for at, c, g in zip(b, costs, given, strict=True):
            own = _moved(*_shaped({"costs": c, "given": g}, n, k))
            out.append(_through(list(own), np.full(n, at == 0), move).ravel())
        return pd.Series(out)

    @F.pandas_udf("array<struct<b:long,before:array<int>,last:array<int>,least:double>>")
    def ends(blocks: pd.Series) -> pd.Series:
        out = []
        for own in blocks:
            tables = np.stack([np.asarray(x["through"], float).reshape(n, k, k) for x in own])
            last, least = np.zeros((len(own), n), int), 0.0
            for i in range(n):
                best = [tables[0, i, 0]]
                for table in tables[1:, i]:
                    best.append((best[-1][:, None] + table).min(axis=0))
                least += best[-1].min()
                last[-1, i] = best[-1].argmin()
                for at in range(len(own) - 1, 0, -1):
                    last[at - 1, i] = (best[at - 1] + tables[at, i, :, last[at, i]]).argmin()
            before = np.concatenate([np.full((1, n), -1), last[:-1]])
            out.append([(x["b"], before[j].tolist(), last[j].tolist(), float(least)) for j, x in enumerate(own)])
        return pd.Series(out)

    @F.pandas_udf("labels array<int>, slopes array<double>, edges double, energy double, square double")
    def looked(costs: pd.Series, given: pd.Series, before: pd.Series, last: pd.Series) -> pd.DataFrame:
        out = []
        for c, g, early, late in zip(costs, given, before, last, strict=True):
            table, multipliers = _shaped({"costs": c, "given": g}, n, k)
            labels = np.array(_labels(list(_moved(table, multipliers)), np.asarray(early), np.asarray(late), move))
            least, at = _edges(multipliers, clash)
            slopes = _slopes(labels, at, k)
            out.append((labels.ravel(), slopes.ravel(), least, _energy(table, labels, move, clash, np.asarray(early)), float((slopes**2).sum())))
        return pd.DataFrame(out, columns=["labels", "slopes", "edges", "energy", "square"])

    state = settled(packed.select("key", "b", "t", begun("costs", "start").alias("x")).select("key", "b", "t", "x.*"))
    # the start's cost: its own labels as known ends
    @F.pandas_udf("array<int>")
    def tail(labels: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x).reshape(n, -1)[:, -1] for x in labels])

    @F.pandas_udf("double")
    def paid(costs: pd.Series, labels: pd.Series, before: pd.Series) -> pd.Series:
        tables = [(np.asarray(c, float).reshape(n, -1, k), np.asarray(s, int).reshape(n, -1)) for c, s in zip(costs, labels, strict=True)]
        return pd.Series([_energy(c, s, move, clash, np.asarray(x) if x is not None else None) for (c, s), x in zip(tables, before, strict=True)])

    tails = state.select("key", (F.col("b") + 1).alias("b"), tail("labels").alias("before"))
    known = state.join(tails, ["key", "b"], "left").groupBy("key").agg(F.sum(paid("costs", "labels", "before")).alias("best"))
    known = settled(known.withColumns({"bound": F.lit(float("-inf")), "step": F.lit(1.0), "far": F.lit(0.0), "better": F.lit(False), "done": F.lit(False)}))
    for _ in range(rounds):
        folded = state.select("key", "b", through("b", "costs", "given").alias("through")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("b", "through"))).alias("blocks"))
        met = state.join(folded.select("key", F.explode(ends("blocks")).alias("e")).select("key", "e.*"), ["key", "b"])
        met = settled(met.select("key", "b", "t", "costs", "given", F.col("labels").alias("kept"), "least", looked("costs", "given", "before", "last").alias("x")).select("key", "b", "t", "costs", "given", "kept", "least", "x.*"))
        sums = met.groupBy("key").agg((F.max("least") + F.sum("edges")).alias("dual"), F.sum("energy").alias("energy"), F.sum("square").alias("square"))
        met_keys = known.join(sums, "key").withColumns({"better": (F.col("energy") < F.col("best")) & ~F.col("done"), "best": F.when(F.col("done"), F.col("best")).otherwise(F.least("best", "energy"))})
        step = F.when(F.col("dual") > F.col("bound") + 1e-9, F.col("step")).otherwise(F.col("step") * SHRINK)
        met_keys = met_keys.withColumns({"step": step, "bound": F.when(F.col("done"), F.col("bound")).otherwise(F.greatest("bound", "dual"))})
        far = F.when(F.col("square") > 0, F.col("step") * (F.col("best") - F.col("dual") + GAP) / F.col("square")).otherwise(0.0)
        met_keys = met_keys.withColumn("done", F.col("done") | (F.col("best") - F.col("bound") <= GAP) | (F.col("square") == 0))
        known = settled(met_keys.select("key", "best", "bound", "step", F.when(F.col("done"), 0.0).otherwise(far).alias("far"), "better", "done"))
        moved = met.join(known.select("key", "far", "better"), "key")
        given = F.zip_with("given", "slopes", lambda g, s: g + F.col("far") * s)
        state = settled(moved.select("key", "b", "t", "costs", given.alias("given"), F.when(F.col("better"), F.col("labels")).otherwise(F.col("kept")).alias("labels")))
        if known.where("NOT done").isEmpty():
            break

    @F.pandas_udf("array<int>")
    def turned(labels: pd.Series) -> pd.Series:
        return pd.Series([np.asarray(x).reshape(n, -1).T.ravel() for x in labels])

    return state.join(known, "key").select("key", "t", turned("labels").alias("labels"), F.col("best").alias("energy"), "bound")
