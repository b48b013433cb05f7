"""Best-fit packing of token sequences with linear grouping of the large lengths."""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.llm.common import bounded, cut
from cinefold.llm.tokens import ByteEncoder

#: Lengths over an eighth of a sequence are large; they are dealt into at most so many groups of equal cardinality.
LARGE, GROUPS = 1 / 8, 32
#: Texts that are encoded at a time.
AT_ONCE = 256
_RANK_BITS = 44


@functools.cache
def _encoder(name: str) -> ByteEncoder:
    return ByteEncoder(name)


def grouped(counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """(rounded length, [[length, number], ...]) of groups that hold about as many items each, longest first."""
    each = max(1, -(-sum(counts.values()) // groups))
    out: list[tuple[int, list[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                out.append((length, []))
                room = each
            n = min(left, room)
            out[-1][1].append([length, n])
            left, room = left - n, room - n
    merged: dict[int, list[list[int]]] = defaultdict(list)
    for length, items in out:  # groups that round up to one length are one size
        merged[length] += items
    return sorted(merged.items(), reverse=True)


def configurations(sizes: list[int], needs: list[int], capacity: int) -> list[tuple[list[int], float]]:
    """([number of each size], times) of the configurations that hold all the needs in the least total times, in fractions.

    Column generation: from configurations of one size each, the one that the current prices of the sizes make dearest
    (a knapsack over the capacity) replaces another, until none is worth more than the one sequence it takes.
    """
    size, m = np.array(sizes), len(sizes)
    held = np.diag(capacity // size).astype(float)
    inverse = np.diag(1 / np.diag(held))
    times = inverse @ np.array(needs, float)
    for _ in range(100 * m):
        price = inverse.sum(axis=0)
        worth, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for room in range(int(size.min()), capacity + 1):
            offers = np.where(size <= room, worth[np.maximum(room - size, 0)] + price, -1)
            best = int(offers.argmax())
            worth[room] = worth[room - 1]
            if offers[best] > worth[room]:
                worth[room], last[room] = offers[best], best
        if worth[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(m), capacity
        while room > 0:
            if last[room] < 0:
                room -= 1
            else:
                column[last[room]] += 1
                room -= sizes[last[room]]
        change = inverse @ column
        ratio = np.full(m, np.inf)
        np.divide(times, change, out=ratio, where=change > 1e-9)
        out = int(ratio.argmin())
        step = ratio[out]
        times -= step * change
        times[out] = step
        held[:, out] = column
        inverse[out] /= change[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(change[others], inverse[out])
    return [([round(n) for n in held[:, j].tolist()], float(times[j])) for j in np.argsort(-times, kind="stable")]


def plan(counts: dict[int, int], capacity: int, large: float = LARGE, groups: int = GROUPS) -> list[tuple[list[int], int]]:
    """([lengths], number of sequences) that hold every item of the histogram {length: number}.

    Large lengths are rounded up to the longest of their group, and configurations of these few sizes are optimised and
    repeated a whole number of times. Then actual lengths take the sizes' places: the longest left of the group, and in
    a sequence's last place the longest of all lengths that fits, so that what rounding up left free is used. What whole
    numbers leave over, and the small lengths, go longest first where they leave the least room, and into new sequences
    where none has room. All work is over counts: it depends on the capacity and the groups, not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c and n < capacity}
    bins: dict[int, list[tuple[list[int], int]]] = defaultdict(list)
    if counts.get(capacity):
        bins[0].append(([capacity], counts[capacity]))
    sizes_items = grouped({n: c for n, c in left.items() if n > capacity * large}, groups)
    if sizes_items:
        sizes, pools, lengths = [size for size, _ in sizes_items], [Counter() for _ in sizes_items], sorted(left)
        for pool, (_, items) in zip(pools, sizes_items, strict=True):
            for length, n in items:
                pool[length] += n
        for places, times in configurations(sizes, [sum(pool.values()) for pool in pools], capacity):
            slots = [i for i, n in enumerate(places) for _ in range(n)]
            for chosen, n in substituted(slots, pools, left, lengths, int(times + 1e-6), capacity):
                bins[capacity - sum(chosen)].append((chosen, n))
    for length in sorted(left, reverse=True):
        items = left[length]
        while items:
            room = min((r for r, held in bins.items() if r >= length and held), default=None)
            if room is None:
                each = capacity // length
                if items >= each:
                    bins[capacity - each * length].append(([length] * each, items // each))
                if items % each:
                    bins[capacity - items % each * length].append(([length] * (items % each), 1))
                break
            chosen, n = bins[room].pop()
            each = min(room // length, items)
            full = min(n, items // each)
            if n > full:
                bins[room].append((chosen, n - full))
            bins[room - each * length].append((chosen + [length] * each, full))
            items -= each * full
    return [(chosen, n) for held in bins.values() for chosen, n in held]


def substituted(slots: list[int], pools: list[dict[int, int]], left: dict[int, int], lengths: list[int], times: int, capacity: int) -> Iterator[tuple[list[int], int]]:
    """([actual lengths], number of sequences) of a configuration's places, taken out of ``pools`` and ``left``.

    It ends early where earlier last places have taken what it needs.
    """
    while times:
        chosen: list[int] = []
        taken, used = Counter(), Counter()
        for i in slots[:-1]:
            length = next((x for x in pools[i] if pools[i][x] > taken[i, x] and left[x] > used[x]), None)
            if length is None:
                return
            chosen.append(length)
            taken[i, length] += 1
            used[length] += 1
        room = capacity - sum(chosen)
        at = bisect_right(lengths, room) - 1
        while at >= 0 and left[lengths[at]] <= used[lengths[at]]:
            at -= 1
        if at >= 0:
            chosen.append(lengths[at])
            used[lengths[at]] += 1
        if not chosen:
            return
        n = min(times, *(left[x] // k for x, k in used.items()), *(pools[i][x] // k for (i, x), k in taken.items()))
        for (i, x), k in taken.items():
            pools[i][x] -= k * n
            if not pools[i][x]:
                del pools[i][x]
        for x, k in used.items():
            left[x] -= k * n
        times -= n
        yield chosen, n


def cut_pieces(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, which holds the rest."""
    head = n % capacity or min(n, capacity)
    return [(0, head)] + [(at, capacity) for at in range(head, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, ident: str, text: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): nth counts a task's pieces of that length, part is its number."""
    kind = dict(docs.dtypes)[ident]

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, part = _encoder(tokenizer), TaskContext.get().partitionId()
        last, seen = np.array([end_id], "<u4").tobytes(), [0] * (capacity + 1)
        for batch in batches:
            ids, texts = batch["doc_id"].tolist(), batch["text"].tolist()
            for k in range(0, len(texts), AT_ONCE):
                rows = []
                for doc_id, own in zip(ids[k : k + AT_ONCE], encoder.encode(texts[k : k + AT_ONCE]), strict=True):
                    own += last
                    for piece, (start, length) in enumerate(cut_pieces(len(own) // 4, capacity)):
                        rows.append((doc_id, piece, start, length, zlib.crc32(own[4 * start : 4 * (start + length)]), part, seen[length]))
                        seen[length] += 1
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    narrow = docs.select(F.col(ident).cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    out = narrow.mapInPandas(encode, "doc_id string, piece int, start long, length long, ids_crc32 long, part int, nth long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", capacity: int = 1024, end_id: int = 2, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece's place in sequences of ``capacity`` tokens.

    A document is its text's ids and ``end_id``; only longer ones than a sequence are cut. Texts are encoded once; their
    pieces, without ids, are kept. The driver sees the histogram of lengths alone (at most ``capacity`` numbers) and plans
    over it; a piece's number among those of its length, from counts per task, says which place of the plan is its own.
    Null and empty texts are one piece of ``end_id``; repeated rows and ids are packed each for itself; columns but the
    id and the text aren't looked at; an empty table gives no rows.
    """
    with bounded(docs.sparkSession):
        made = cut(pieces(docs, tokenizer, capacity, end_id, ident, text))
    counts = made.groupBy("part", "length").count()
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    base = cut(counts.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))))
    histogram = {r["length"]: r["n"] for r in base.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    keys, first, offsets = [], [], []
    used: dict[int, int] = defaultdict(int)
    sequences = 0
    for lengths, n in plan(histogram, capacity):
        offset = 0
        for length in lengths:
            keys.append((length << _RANK_BITS) + used[length])
            first.append(sequences - used[length])
            offsets.append(offset)
            used[length] += n
            offset += length
        sequences += n
    order = np.argsort(np.array(keys, dtype=np.int64))
    packed = docs.sparkSession.sparkContext.broadcast(tuple(np.array(x, dtype=np.int64)[order] for x in (keys, first, offsets)))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        keys, first, offsets = packed.value
        at = np.searchsorted(keys, (length.to_numpy() << _RANK_BITS) + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": first[at] + rank.to_numpy(), "offset": offsets[at]})

    rows = made.join(F.broadcast(base.select("part", "length", "base")) if base.count() <= 100_000 else base.select("part", "length", "base"), ["part", "length"])
    rows = rows.withColumn("_at", placed("length", F.col("nth") + F.col("base")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_at.sequence_id").alias("sequence_id"), F.col("_at.offset").alias("offset"))
