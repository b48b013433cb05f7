"""Exact top-k search by inner product with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.llm.vptree import BLOCK_QUERIES, SHARD_ROWS, matrix, sharded, usable

#: Documents in a block of the forward index.
BLOCK = 128
_LONG = 2**63


def exact(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Integer products of whole-number matrices: in doubles where they hold every sum, else in Python integers."""
    high = np.abs(left).max(initial=0) * np.abs(right).max(initial=0) * max(1, left.shape[1])
    if high < 2**53:
        return left @ right.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object).reshape(m.shape)
    return whole(left) @ whole(right).T


class Blocks:
    """A shard's rows by ascending id in blocks, with each term's largest and smallest value in a block."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, size: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows, self.size = ids[order], rows[order], size
        starts = np.arange(0, len(ids), size)
        self.starts, self.most, self.least = starts, np.maximum.reduceat(self.rows, starts, axis=0), np.minimum.reduceat(self.rows, starts, axis=0)

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[list[list[tuple]], int]:
        """(-score, id) of each query's k best ids, and the number of blocks scored.

        A block's bound sums, over the terms of the query, the term's maximum in the block times its weight (for a
        negative weight, the minimum). Blocks are scored by falling bound until it lies under the kth score; a bound
        equal to it is scored too, since a tie may have a smaller id.
        """
        bound = exact(np.maximum(queries, 0), self.most) + exact(np.minimum(queries, 0), self.least)
        order = np.argsort(-bound.astype(np.float64), axis=1, kind="stable")
        best: list[list[tuple]] = [[] for _ in own]
        active, scored = np.arange(len(own)), 0
        # Bounds over 2**53 are ordered as doubles; the slack keeps such rounding from ending a search early.
        slack = 0 if bound.dtype != object else int(abs(bound).max()) >> 40
        for step in range(len(self.starts)):
            active = np.array([q for q in active if len(best[q]) < k or bound[q, order[q, step]] + slack >= -best[q][-1][0]], dtype=np.int64)
            if not len(active):
                break
            at = order[active, step]
            for block in np.unique(at):
                members = active[at == block]
                span = slice(self.starts[block], self.starts[block] + self.size)
                points = exact(queries[members], self.rows[span])
                scored += len(members)
                ids = self.ids[span]
                for q, row in zip(members.tolist(), points, strict=True):
                    if len(best[q]) >= k:
                        keep = np.flatnonzero(row >= -best[q][-1][0])
                    else:
                        keep = np.arange(len(row))
                    fresh = [(-int(row[j]), int(ids[j])) for j in keep.tolist() if ids[j] != own[q]]
                    if fresh:
                        distinct: dict[int, int] = {}
                        for score, i in sorted({*best[q], *fresh}):
                            distinct.setdefault(i, score)
                        best[q] = [(score, i) for i, score in distinct.items()][:k]
        return best, scored


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, ident: str = "vec_id", vector: str = "embedding", shard_rows: int = SHARD_ROWS, block: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the highest integer inner product, ties to the smaller id.

    Components become floor(scale * x). Blocks of queries meet every shard's block index, and a window picks the final
    k. Rows with the query's own id are left out, as are rows with a null id and vectors that are null or hold null or
    non-finite components, on both sides. Only vectors of the query's dimension are scored. Repeated rows count once; of
    several vectors with one id the best counts; scores beyond a long are held at its ends; empty tables give no rows.
    """
    whole = lambda column, dim: np.floor(scale * matrix(column, dim))
    rows, shards = sharded(vectors, ident, vector, True, shard_rows)
    asked = queries.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector"), True)).dropDuplicates(["id", "vector"])
    blocks = max(1, -(-asked.count() // block))
    asked = asked.withColumns({"dim": F.size("vector"), "block": F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"), "shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))})
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def visit(key: tuple, part: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(part) and len(want):
            index = Blocks(part["id"].to_numpy(np.int64), whole(part["vector"], key[0]))
            own = want["id"].to_numpy(np.int64)
            for q, found in zip(own.tolist(), index.search(own, whole(want["vector"], key[0]), k)[0], strict=True):
                out += [(q, i, max(-_LONG, min(_LONG - 1, -s))) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ("dim", "shard", "block")
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInPandas(visit, "query_id long, vec_id long, score long")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
WITH v AS (
    SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v q JOIN v ON q.vec_id <> v.vec_id AND len(q.e) = len(v.e) WHERE q.vec_id % 50 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
