"""Approximate nearest neighbours by one vantage-point tree per shard."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows in a shard, queries in a block, points in a leaf.
SHARD_ROWS, BLOCK_QUERIES, LEAF = 16384, 8192, 64


def usable(vector: Column, zero: bool) -> Column:
    """Whether a vector is there with finite components alone; ``zero`` lets zero vectors pass."""
    fine = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return fine if zero else fine & F.exists(vector, lambda x: x != 0)


def sharded(vectors: DataFrame, ident: str, vector: str, zero: bool, shard_rows: int) -> tuple[DataFrame, int]:
    """Usable rows as (id, vector, dim, shard) without repetitions, and the number of shards, which follows the rows."""
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), zero))
    shards = max(1, -(-rows.count() // shard_rows))
    rows = rows.dropDuplicates(["id", "vector"])
    return rows.withColumns({"dim": F.size("vector"), "shard": F.pmod(F.xxhash64("id", "vector"), F.lit(shards)).cast("int")}), shards


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.array(column.tolist(), dtype=np.float64).reshape(len(column), dim)


class Tree:
    """A vantage-point tree over distinct points, each with the ascending ids of the rows that hold it."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF, seed: int = 7):
        order = np.lexsort((ids, *points.T[::-1]))
        ids, points = ids[order], points[order]
        new = np.ones(len(ids), bool)
        new[1:] = (points[1:] != points[:-1]).any(axis=1)
        self.start = np.append(np.flatnonzero(new), len(ids))
        self.ids, self.points = ids, points[new]
        self.norms = np.einsum("ij,ij->i", self.points, self.points)
        self.least = ids[self.start[:-1]]
        random = np.random.default_rng(seed)
        self.nodes: list[tuple] = []
        waiting = [(np.arange(len(self.points)), -1, 0)]
        while waiting:
            items, parent, side = waiting.pop()
            at = len(self.nodes)
            if parent >= 0:
                self.nodes[parent][2 + side] = at
            if len(items) <= leaf:
                self.nodes.append([None, items])
                continue
            vantage = int(items[random.integers(len(items))])
            away = np.sqrt(((self.points[items] - self.points[vantage]) ** 2).sum(axis=1))
            half = len(items) // 2
            parts = np.argpartition(away, half)
            self.nodes.append([vantage, (away[parts[:half]].max(), away[parts[half:]].min()), -1, -1])
            waiting += [(items[parts[half:]], at, 1), (items[parts[:half]], at, 0)]

    def search(self, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Distances and points of the k nearest points found for each query, padded with inf and -1.

        A far side is entered if its gap in distance to the vantage point is at most ``factor`` times the distance of
        the kth found; a factor of one follows the triangle inequality and is exact.
        """
        n = len(queries)
        best, which = np.full((n, k), np.inf), np.full((n, k), -1)
        norms = np.einsum("ij,ij->i", queries, queries)
        seen = np.full(n, -1)

        def scan(node: int, q: np.ndarray) -> None:
            items = self.nodes[node][1]
            rough = norms[q][:, None] + self.norms[items][None] - 2 * queries[q] @ self.points[items].T
            scale = norms[q][:, None] + self.norms[items][None]
            a, b = np.nonzero(rough <= (best[q, -1] ** 2)[:, None] + 1e-9 * scale)
            exact = np.full(rough.shape, np.inf)
            exact[a, b] = np.sqrt(np.cumsum((queries[q[a]] - self.points[items[b]]) ** 2, axis=1)[:, -1])
            away, found = np.hstack((best[q], exact)), np.hstack((which[q], np.broadcast_to(items, rough.shape)))
            first = np.lexsort((np.where(found < 0, 0, self.least[found]), away))[:, :k]
            best[q], which[q] = np.take_along_axis(away, first, 1), np.take_along_axis(found, first, 1)
            which[best == np.inf] = -1

        def distances(vantage: int, q: np.ndarray) -> np.ndarray:
            return np.sqrt(((queries[q] - self.points[vantage]) ** 2).sum(axis=1))

        down = [(0, np.arange(n))]
        while down:  # every query's own leaf first, for a bound
            node, q = down.pop()
            if self.nodes[node][0] is None:
                scan(node, q)
                seen[q] = node
                continue
            vantage, (inner, outer), left, right = self.nodes[node]
            near = distances(vantage, q) <= (inner + outer) / 2
            down += [(child, part) for child, part in ((right, q[~near]), (left, q[near])) if len(part)]
        down = [(0, np.arange(n))]
        while down:
            node, q = down.pop()
            if self.nodes[node][0] is None:
                if len(q := q[seen[q] != node]):
                    scan(node, q)
                continue
            vantage, (inner, outer), left, right = self.nodes[node]
            away = distances(vantage, q)
            within = factor * best[q, -1] + 1e-9 * (1 + away)
            down += [(child, part) for child, part in ((right, q[outer - away <= within]), (left, q[away - inner <= within])) if len(part)]
        return best, which


def build(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, int]:
    """(dim, shard, tree) with one pickled tree a shard over every usable row, and the number of shards."""
    rows, shards = sharded(vectors, ident, vector, False, shard_rows)

    def plant(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(part["id"].to_numpy(np.int64), matrix(part["vector"], key[0]))
        return pd.DataFrame({"dim": [key[0]], "shard": [key[1]], "tree": [pickle.dumps(tree)]})

    return rows.groupBy("dim", "shard").applyInPandas(plant, "dim int, shard int, tree binary"), shards


def search(index: tuple[DataFrame, int], queries: DataFrame, k: int = 10, factor: float = 0.5, ident: str = "vec_id", vector: str = "embedding", block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, by Euclidean distance.

    Blocks of at most about ``block`` queries meet every shard's tree; each keeps k rows a query, and a window over
    those picks the final k, ties to the smaller id. Rows with the query's own id are left out, as are rows with a null
    id and vectors that are null, zero, empty or hold null or non-finite components, on both sides. Only vectors of the
    query's dimension are near it. Repeated rows count once; fewer rows than k are all returned; empty tables give none.
    """
    trees, shards = index
    asked = queries.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), False)).dropDuplicates(["id", "vector"])
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    trees = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(key: tuple, tree: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        if len(tree) and len(part):
            planted: Tree = pickle.loads(tree["tree"].iloc[0])
            points, owns = matrix(part["vector"], key[0]), part["id"].to_numpy(np.int64)
            todo, wide = np.arange(len(owns)), k + 1
            while len(todo):  # where own and repeated ids leave fewer than k, more points are asked for
                short = []
                for q, distances, near in zip(todo.tolist(), *(x.tolist() for x in planted.search(points[todo], wide, factor)), strict=True):
                    own, best = int(owns[q]), {}
                    for d, p in zip(distances, near, strict=True):
                        if p >= 0:
                            for i in planted.ids[planted.start[p] : planted.start[p + 1]][: k + 1].tolist():
                                if i != own:
                                    best.setdefault(i, d)
                    if len(best) < k and near[-1] >= 0:
                        short.append(q)
                    else:
                        rows += [(own, i, d) for d, i in sorted((d, i) for i, d in best.items())[:k]]
                todo, wide = np.array(short, np.int64), 2 * wide
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    keys = ("dim", "shard", "block")
    found = trees.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(visit, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, embedding::DOUBLE[] AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, v.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""
