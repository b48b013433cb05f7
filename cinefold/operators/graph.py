"""Connected components as DataFrame joins, by repeated contraction of the edges."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.session import settled

#: At most so many edges are left to one task, which joins them at once.
FEW = 1 << 14


def united(n: int, links: Iterable[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of every member's component, of n members and links between them."""
    top = np.arange(n)
    for a, b in links:
        a, b = top[a], top[b]
        while (a != b).any():
            a, b = a[a != b], b[a != b]
            np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
            while not np.array_equal(top, top[top]):
                top = top[top]
            a, b = top[a], top[b]
    return top


def _joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(at, to) of every node on the edges of one task."""
    parts = [(b["a"].to_numpy(), b["b"].to_numpy()) for b in batches if len(b)]
    if parts:
        ends = np.concatenate([np.concatenate(p) for p in zip(*parts, strict=True)])
        nodes, number = np.unique(ends, return_inverse=True)
        yield pd.DataFrame({"at": nodes, "to": nodes[united(len(nodes), [tuple(number.reshape(2, -1))])]})


def _pointers(edges: DataFrame) -> DataFrame:
    """(at, to): every node's root, when each node points at its smallest neighbour.

    Such pointers have no cycles but pairs that point at each other, whose smaller node is the root; so every tree has
    two nodes or more. Pointers are doubled until all of them end at a root.
    """
    both = edges.select("a", "b").union(edges.select("b", "a"))
    to = both.groupBy(F.col("a").alias("at")).agg(F.min("b").alias("to"))
    back = to.select(F.col("at").alias("to"), F.col("to").alias("back"))
    own = (F.col("back") == F.col("at")) & (F.col("at") < F.col("to"))
    up = settled(to.join(back, "to").select("at", F.when(own, F.col("at")).otherwise(F.col("to")).alias("to")))
    while True:
        over = up.select(F.col("at").alias("to"), F.col("to").alias("top"))
        step = settled(up.join(over, "to").select("at", F.col("top").alias("to"), (F.col("top") != F.col("to")).alias("moved")))
        up = step.select("at", "to")
        if step.where("moved").isEmpty():
            return up


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the smallest node reachable.

    Each round contracts trees of two nodes or more to their roots, so the nodes that are still on an edge at least
    halve and the rounds are logarithmic, whatever the order of the names; when at most ``few`` edges are left, one task
    joins them (0: never, and only DataFrame operations are used). Minima are combined before the shuffle and pointers
    are unique by node, so a hub only makes the edge side of a join uneven, which adaptive execution splits. Edges with
    a null end are dropped, loops keep their node as its own component; repeated edges count once; no edges give no rows.
    """
    first = settled(edges.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct())
    kind = first.schema["a"].dataType.simpleString()
    member = first.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("top", F.col("node"))
    edges = first.where("a <> b")
    while left := edges.count():
        up = settled(edges.coalesce(1).mapInPandas(_joined, f"at {kind}, to {kind}")) if left <= few else _pointers(edges)
        member = settled(member.join(up, member.top == up.at, "left").select("node", F.coalesce("to", "top").alias("top")))
        if left <= few:
            break
        ends = edges
        for c in ("a", "b"):
            ends = ends.join(up.select(F.col("at").alias(c), F.col("to").alias(f"{c}_top")), c)
        edges = settled(
            ends.where("a_top <> b_top").select(F.least("a_top", "b_top").alias("a"), F.greatest("a_top", "b_top").alias("b")).distinct()
        )
    least = member.groupBy("top").agg(F.min("node").alias("component"))
    return member.join(least, "top").select("node", "component")
