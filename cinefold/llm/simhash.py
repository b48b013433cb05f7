"""SimHash near-duplicates with BK-trees over the distinct fingerprints."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.llm.common import bounded, cut
from cinefold.llm.components import connected_components, united

#: Differing bits at which fingerprints still link, words of a shingle, seed of the hash.
RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints that chance brings together in a bucket, and most in a shard's tree; a bucket with more than that is
#: split into shards that meet two by two.
BUCKET, SHARD = 1024, 4096
#: Pairs of a fingerprint and a tree node that are looked at in one go.
FRONTIER = 1 << 18
#: Shingles of a text whose bits are unpacked at a time.
AT_ONCE = 1 << 16


def fingerprint(text: str, words: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text, unsigned; 0 without words."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()  # bytes: ASCII letters and white space alone
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    first = np.concatenate(([0], ends[:-1] + 1))[: len(found) - words + 1].tolist()
    last = ends[words - 1 :].tolist()
    n = len(first)
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(first[k : k + AT_ONCE], last[k : k + AT_ONCE], strict=True)), np.uint64) for k in range(0, n, AT_ONCE))


def majority(parts: Iterable[np.ndarray]) -> int:
    """The bits set in over half of the 64-bit hashes, of which some are given at a time."""
    counts, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, ident: str, text: str, words: int, seed: int) -> DataFrame:
    """(id, fp) of every row, fp as a signed long."""

    @F.pandas_udf("long")
    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.array([fingerprint(x, words, seed) for x in batch], dtype=np.uint64).view(np.int64))

    return docs.select(F.col(ident).alias("id"), hashed(F.coalesce(F.col(text), F.lit(""))).alias("fp"))


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of several shards: every child is keyed by its Hamming distance to the parent.

    Values are unsigned fingerprints, ``tree`` their shard's number, ascending. Building goes level by level: of the
    values that reach a node with the same distance the first becomes the child and the others go on from it, which
    gives the tree that inserting them one by one gives.
    """

    def __init__(self, values: np.ndarray, tree: np.ndarray):
        self.values = values
        first = np.flatnonzero(np.diff(tree, prepend=-1))
        self.roots = first[np.cumsum(np.diff(tree, prepend=-1) != 0) - 1]
        going = np.setdiff1d(np.arange(len(values)), first, assume_unique=True)
        at = self.roots[going]
        codes, children = [], []
        while len(going):
            code = at * 65 + distance(values[going], values[at])
            _, lead, of = np.unique(code, return_index=True, return_inverse=True)
            codes.append(code[lead])
            children.append(going[lead])
            new = going[lead][of]
            going, at = going[new != going], new[new != going]
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        child = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(code)
        self.codes, self.children = code[order], child[order]

    def links(self, queries: np.ndarray, roots: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query's number, node) within the radius, following only edges whose key is within it of the node's distance."""
        for k in range(0, len(queries), max(1, FRONTIER // 64)):
            waiting = [(np.arange(k, min(len(queries), k + FRONTIER // 64)), roots[k : k + FRONTIER // 64])]
            while waiting:
                q, node = waiting.pop()
                if len(q) > FRONTIER:
                    half = len(q) // 2
                    waiting += [(q[:half], node[:half]), (q[half:], node[half:])]
                    continue
                away = distance(queries[q], self.values[node])
                near = away <= radius
                if near.any():
                    yield q[near], node[near]
                low = np.searchsorted(self.codes, node * 65 + np.maximum(away - radius, 0))
                n = np.searchsorted(self.codes, node * 65 + np.minimum(away + radius, 64), side="right") - low
                if total := int(n.sum()):
                    step = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
                    waiting.append((np.repeat(q, n), self.children[np.repeat(low, n) + step]))


def blocks_for(rows: int, radius: int, bucket: int = BUCKET) -> int:
    """Blocks of a fingerprint: with b of them, links agree in b - radius whole ones.

    As few as keep a bucket of unrelated fingerprints at ``bucket`` members: more rows, longer keys.
    """
    blocks = radius + 1
    while blocks < min(64, radius + 4) and rows >> (64 * (blocks - radius) // blocks) > bucket:
        blocks += 1
    return blocks


def keys(fp: Column, blocks: int, radius: int) -> Column:
    """One key for each choice of blocks - radius blocks: the fingerprint's bits in them, and the choice's number."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    out = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum((1 << edges[i + 1]) - (1 << edges[i]) for i in chosen)
        signed = mask - (1 << 64) if mask >> 63 else mask
        out.append(F.struct(F.lit(n).alias("table"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return F.array(*out)


def star_links(found: DataFrame, radius: int, shard: int) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that join just what links of at most ``radius`` bits join.

    Fingerprints that link agree in whole blocks, so they meet in a bucket. A bucket is a shard with its own BK-tree;
    one with more than ``shard`` members is dealt into shards, and every two of those meet in a unit of their own: one
    gives the tree, both ask. Within a unit, links become a star around each component's first member, so rows follow
    the members and not the pairs.
    """
    n = found.count()
    blocks = blocks_for(n, radius)
    keyed = found.select("fp", F.explode(keys(F.col("fp"), blocks, radius)).alias("key")).select("fp", "key.table", "key.bits")
    sizes = keyed.groupBy("table", "bits").count().where(f"count > {shard}")
    big = sizes.withColumn("shards", F.ceil(F.col("count") / shard).cast("int")).drop("count")
    big = cut(big)
    if big.isEmpty():
        units = keyed.withColumns({"i": F.lit(0), "j": F.lit(0)})
    else:
        dealt = keyed.join(big, ["table", "bits"], "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int"))
        units = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        units = units.select("fp", "table", "bits", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def done(parts: list[pd.DataFrame]) -> pd.DataFrame:
            part = pd.concat(parts)
            columns = [part[c].to_numpy() for c in ("table", "bits", "i", "j")]
            new = np.zeros(len(part), bool)
            new[:1] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            tree = np.cumsum(new) - 1
            alone = np.bincount(tree)[tree] == 1
            fp, tree = part["fp"].to_numpy()[~alone], tree[~alone]
            if not len(fp):
                return pd.DataFrame({"a": fp, "b": fp})
            values = fp.view(np.uint64)
            forest = Forest(values, tree)
            top = united(len(fp), forest.links(values, forest.roots, radius))
            moved = top != np.arange(len(fp))
            return pd.DataFrame({"a": fp[moved], "b": fp[top[moved]]})

        held: list[pd.DataFrame] = []
        for batch in batches:  # whole units are worked on; the last of a batch may go on in the next
            if len(batch):
                last = batch[["table", "bits", "i", "j"]].iloc[-1]
                open_ = (batch[["table", "bits", "i", "j"]] == last).all(axis=1).to_numpy()
                if not open_.all():
                    yield done([*held, batch[~open_]])
                    held = []
                elif held and not (held[-1][["table", "bits", "i", "j"]].iloc[-1] == last).all():
                    yield done(held)
                    held = []
                held.append(batch[open_])
        if held:
            yield done(held)

    unit = ["table", "bits", "i", "j"]
    return units.repartition(*unit).sortWithinPartitions(*unit, "fp").mapInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = SHINGLE, seed: int = SEED, shard: int = SHARD) -> DataFrame:
    """(id, fingerprint, component_id) of every row: its SimHash in 16 hex digits and the smallest id that links reach.

    Copies collapse to one fingerprint before anything is compared. Null and empty texts have fingerprint zero, which
    links like any other. A row with a null id has its group's smallest id, null if the group has none; repeated rows
    and ids are returned as often as they come; other columns aren't looked at; an empty table gives no rows.
    """
    with bounded(docs.sparkSession):
        rows = cut(fingerprints(docs, ident, text, words, seed))
    found = cut(rows.groupBy("fp").agg(F.min("id").alias("least")))
    member = connected_components(star_links(found.select("fp"), radius, shard))
    grouped = cut(found.join(member, found.fp == member.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    least = grouped.where("component <> fp OR least IS NOT NULL").groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(least, "component", "left").select("fp", "component_id")
    shown = F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint")
    return rows.join(named, "fp").select("id", shown, "component_id")


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of one document of each near-duplicate group: that with the group's smallest id.

    Rows that repeat that id stay. Groups without any id, and rows with a null id in groups that have one, go
    together: the former keep all their rows, the latter none.
    """
    found = near_duplicates(docs.select(ident, text), ident, text, **options)
    kept = found.where("id <=> component_id").select(F.col("id").alias("_kept")).distinct()
    return docs.join(kept, docs[ident].eqNullSafe(F.col("_kept")), "left_semi")
