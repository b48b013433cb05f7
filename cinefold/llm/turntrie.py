"""Prefix trie of conversations by an external mergesort that carries longest common prefixes (LCPs).

A conversation is a key: its turns' records one after another, each a turn's digest and length. Keys are dealt by ranges.
Within a range they become sorted runs with LCPs, cut into blocks; a loser tree merges the runs without comparing shared
turns again, and a stack holds the nodes on the path of the key that came last. A node that leaves the path is finished.
What ranges share, the nodes on the paths of their first and last keys, is put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinefold.llm.common import bounded, cut

#: Bytes of a turn in a key: 16 of its digest, 8 of its length in code points.
RECORD = 24
#: Bytes of keys that are sorted at a time, and of a block.
RUN, BLOCK = 8 << 20, 64 << 10
#: Ends of a node that are hashed at a time, children that wait for their parent's smallest member, rows of a batch.
CHUNK, WAITING, BATCH = 4096, 1024, 4096
#: Every hundredth conversation lends the others of its hundred up to five first turns.
EVERY, DRAWS = 100, 6

EMPTY = hashlib.sha256(b"").hexdigest()


# keys ---------------------------------------------------------------------------------------------------------------


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's turns as records in hex, by turn, null first, then by digest.

    Only records are shuffled. Null roles and texts are empty; rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    record = F.concat(F.substring(digest, 1, 32), F.lpad(F.hex(F.length(text).cast("long")), 16, "0"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", record.alias("record"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "record"))).alias("listed"))
    return listed.select("conv_id", F.col("listed.record").alias("turns"))


def with_shared_heads(found: DataFrame, every: int = EVERY, draws: int = DRAWS) -> DataFrame:
    """The sequences, their first h turns replaced by those of the conversation at the start of their hundred.

    h is the CRC-32 of the decimal conv_id modulo ``draws``; what the first conversation lacks is left out.
    """
    heads = found.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("hub"), F.slice("turns", 1, draws - 1).alias("head"))
    own = found.withColumns({"hub": F.col("conv_id") - F.col("conv_id") % every, "h": (F.crc32(F.col("conv_id").cast("string")) % draws).cast("int")})
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return own.join(heads, "hub", "left").select("conv_id", F.concat(head, rest).alias("turns"))


def shared(a: bytes, b: bytes, known: int) -> int:
    """Turns that two keys share at their start, of which some are known."""
    most, at = min(len(a), len(b)), known * RECORD
    while at < most and a[at : at + RECORD] == b[at : at + RECORD]:
        at += RECORD
    return at // RECORD


# runs ---------------------------------------------------------------------------------------------------------------

#: Rows of a block: the key before it in its run (null: it is the first), its run, whether it is the run's last, and each
#: key's LCP with the one before, the rest of it, and its conversation.
BLOCKS = "after binary, after_id long, run int, last boolean, lcps array<int>, rests array<binary>, ids array<long>"
_BLOCK_ROW = pa.schema([("after", pa.binary()), ("after_id", pa.int64()), ("run", pa.int32()), ("last", pa.bool_()), ("lcps", pa.list_(pa.int32())), ("rests", pa.list_(pa.binary())), ("ids", pa.list_(pa.int64()))])


def run_blocks(keys: list[tuple[bytes, int]], run: int, block: int) -> Iterator[tuple]:
    """One sorted run's blocks."""
    keys.sort()
    after: tuple = (None, None)
    previous, size = b"", 0
    lcps, rests, ids = [], [], []
    for key, ident in keys:
        if size >= block:
            yield (*after, run, False, lcps, rests, ids)
            after, size = (previous, ids[-1]), 0
            lcps, rests, ids = [], [], []
        same = shared(previous, key, 0)
        lcps.append(same)
        rests.append(key[same * RECORD :])
        ids.append(ident)
        size += len(rests[-1]) + 16
        previous = key
    yield (*after, run, True, lcps, rests, ids)


def runs(rows: Iterable[tuple[bytes, int]], size: int = RUN, block: int = BLOCK) -> Iterator[tuple]:
    """The blocks of sorted runs of so many bytes."""
    held, weight, run = [], 0, 0
    for row in rows:
        held.append(row)
        weight += len(row[0]) + 64
        if weight >= size:
            yield from run_blocks(held, run, block)
            held, weight, run = [], 0, run + 1
    if held:
        yield from run_blocks(held, run, block)


# merge --------------------------------------------------------------------------------------------------------------


class LoserTree:
    """Merges runs of (key, id); every head knows its LCP with the key that came last.

    Of two heads the one with the longer LCP is smaller, and the other's LCP is also what the two share. Only heads with
    equal LCPs are compared, from there on; the loser then keeps what it shares with the winner, which is the key that
    it will next be measured against.
    """

    def __init__(self, sources: list[Iterator[tuple[int, bytes, int]]]):
        self.sources, n = sources, len(sources)
        self.heads: list[tuple[bytes, int] | None] = [None] * n
        self.lcps = [0] * n
        for i in range(n):
            self._advance(i)
            self.lcps[i] = 0
        self.losers, winners = [0] * n, [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if n > 1 else 0

    def _advance(self, i: int) -> None:
        step = next(self.sources[i], None)
        if step is None:
            self.heads[i] = None
        else:
            self.lcps[i], key, ident = step
            self.heads[i] = key, ident

    def _play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        if self.lcps[i] != self.lcps[j]:
            return (i, j) if self.lcps[i] > self.lcps[j] else (j, i)
        same = shared(a[0], b[0], self.lcps[i])
        at = same * RECORD
        i_first = (a[0][at : at + RECORD], a[1]) <= (b[0][at : at + RECORD], b[1])
        won, lost = (i, j) if i_first else (j, i)
        self.lcps[lost] = same
        return won, lost

    def __iter__(self) -> Iterator[tuple[bytes, int, int]]:
        """(key, id, LCP with the key before), ascending."""
        n = len(self.sources)
        while n and (head := self.heads[self.winner]) is not None:
            yield *head, self.lcps[self.winner]
            at = self.winner
            self._advance(at)
            node = (at + n) // 2
            while node:
                at, self.losers[node] = self._play(at, self.losers[node])
                node //= 2
            self.winner = at


def merged(blocks: Iterator[tuple]) -> Iterator[tuple[bytes, int, int]]:
    """The keys of all runs in order, from blocks that are sorted by the key before them.

    First blocks have none and come first. Any other is wanted when the key before it has been merged, so blocks come
    in the order in which they are wanted, and one a run is held.
    """
    waiting: dict[int, deque] = {}
    ahead = None
    for block in blocks:
        if block[0] is not None:
            ahead = block
            break
        waiting[block[2]] = deque([block])

    def source(run: int) -> Iterator[tuple[int, bytes, int]]:
        nonlocal ahead
        key, last = b"", False
        while not last:
            while not waiting[run]:
                waiting[ahead[2]].append(ahead)
                ahead = next(blocks, None)
            *_, last, lcps, rests, ids = waiting[run].popleft()
            for same, rest, ident in zip(lcps, rests, ids, strict=True):
                key = key[: same * RECORD] + rest
                yield same, key, ident

    return iter(LoserTree([source(run) for run in list(waiting)]))


# nodes --------------------------------------------------------------------------------------------------------------

#: What a range gives: finished nodes, its parts of nodes that other ranges may share, and chunks of long lists of ends.
#: A node waits for the parent named by ``parent``, and for the digest of its ends' chunks where ``ends_sha256`` is null.
FOUND = "kind string, piece int, place long, key binary, parent binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string, chunk string"
_FOUND_ROW = pa.schema([(c, {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for c, t in (x.split() for x in FOUND.split(", "))])


@dataclass(slots=True)
class Node:
    key: bytes
    parent: bytes | None
    depth: int
    chars: int
    place: int
    open: bool
    conv: int | None = None
    convs: int = 0
    kids: int = 0
    leaves: int = 0
    saved: int = 0
    ends: list[int] = field(default_factory=list)
    chunks: int = 0
    named: bool = False
    waiting: list[dict] = field(default_factory=list)


def path_nodes(stream: Iterable[tuple[bytes, int, int]], piece: int, chunk: int = CHUNK, most: int = WAITING) -> Iterator[dict]:
    """What a range of merged keys gives. Nodes on the path of its first or last key are parts, all others finished."""
    out: list[dict] = []
    path: list[Node] = []
    place = 0

    def push(parent: Node | None, record: bytes, first: bool) -> None:
        nonlocal place
        above = parent.key if parent else b""
        path.append(Node(hashlib.blake2b(above + record, digest_size=16).digest(), parent and above, len(path), int.from_bytes(record[16:]), place, first))
        place += 1

    def give_ends(node: Node) -> None:
        out.append({"kind": "ends", "piece": piece, "place": node.chunks, "key": node.key, "chunk": ",".join(map(str, node.ends))})
        node.ends, node.chunks = [], node.chunks + 1

    def finish(node: Node, above: Node | None, edge: bool) -> None:
        """``edge``: the node may have ends in other ranges."""
        if node.ends and (edge or node.chunks):
            give_ends(node)
        row = {"kind": "node", "depth": node.depth, "conv_id": node.conv, "n_convs": node.convs, "n_children": node.kids}
        if not node.chunks:
            row["ends_sha256"] = hashlib.sha256(",".join(map(str, node.ends)).encode()).hexdigest() if node.ends or not node.open else None
        if node.open:
            out.extend(x | {"parent": node.key} for x in node.waiting)
            row |= {"kind": "part", "piece": piece, "place": node.place, "key": node.key, "parent": node.parent, "n_leaves": node.leaves, "saved_tokens": node.saved, "chars": node.chars}
            out.append(row)
        else:
            out.extend(x | {"parent_conv_id": node.conv} for x in node.waiting)
            node.leaves += not node.kids
            node.saved += (node.convs - 1) * node.chars
            row |= {"n_leaves": node.leaves, "saved_tokens": node.saved, "key": node.key if node.named or node.chunks else None}
            above.kids += 1
            above.leaves += node.leaves
            above.saved += node.saved
            above.waiting.append(row)
            if len(above.waiting) > most:
                out.extend(x | {"parent": above.key} for x in above.waiting)
                above.waiting, above.named = [], True
        if above:
            above.convs += node.convs
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)

    first = True
    edge: Node | None = None  # the first key's node
    for key, ident, same in stream:
        if first:
            push(None, bytes(RECORD), True)
        while len(path) - 1 > same:
            node = path.pop()
            finish(node, path[-1], node is edge)
        for at in range(same * RECORD, len(key), RECORD):
            push(path[-1], key[at : at + RECORD], first)
        node = path[-1]
        edge = node if first else edge
        first = False
        node.convs += 1
        node.conv = ident if node.conv is None else min(node.conv, ident)
        node.ends.append(ident)
        if len(node.ends) >= chunk:
            give_ends(node)
        if len(out) >= BATCH:
            yield from out
            out.clear()
    last = path[-1] if path else None
    for node in path:
        node.open = True
    while path:
        node = path.pop()
        finish(node, path[-1] if path else None, node is last or node is edge)
    yield from out


def joined_parts(parts: Iterable[dict]) -> Iterator[dict]:
    """The nodes whose parts come by range and place, so that a node's own follow its parent's and precede its child's.

    A stack of the open ones is held; the sums of a part leave out children that are parts themselves.
    """
    path: list[dict] = []

    def finish() -> dict:
        node = path.pop()
        node["n_leaves"] += not node["n_children"]
        node["saved_tokens"] += (node["n_convs"] - 1) * node["chars"]
        if path:
            path[-1]["n_leaves"] += node["n_leaves"]
            path[-1]["saved_tokens"] += node["saved_tokens"]
        return node

    for part in parts:
        depth = part["depth"]
        if len(path) > depth and path[depth]["key"] == part["key"]:
            node = path[depth]
            for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                node[c] += part[c]
            node["conv_id"] = min(node["conv_id"], part["conv_id"])
            node["ends_sha256"] = node["ends_sha256"] or part["ends_sha256"]
            continue
        while len(path) > depth:
            yield finish()
        if path:
            path[-1]["n_children"] += 1
        path.append(dict(part, kind="node"))
    while path:
        yield finish()


# on Spark -----------------------------------------------------------------------------------------------------------


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(x.to_pylist() for x in batch.columns), strict=True)


def _batched(rows: Iterable, schema: pa.Schema, weigh: Callable[[object], int], most: int) -> Iterator[pa.RecordBatch]:
    held, weight = [], 0
    for row in rows:
        held.append(row if isinstance(row, dict) else dict(zip(schema.names, row, strict=True)))
        weight += weigh(row)
        if weight >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def prefix_trie(found: DataFrame, run: int = RUN, block: int = BLOCK, chunk: int = CHUNK, most: int = WAITING) -> DataFrame:
    """The nodes of the trie of sequences (conv_id, turns): a row for each distinct sequence of first turns.

    conv_id is the smallest member; n_leaves and saved_tokens are summed over the subtree, the node included; ends_sha256
    is that of the members without further turns. The root is there with the first conversation; an empty table gives
    no rows. Equal sequences share all nodes, whatever their number: ranges are cut inside them too.

    A conversation's records, 24 bytes a turn, are one row. In a task a run (8 MB) or one block a run (64 KB), the open
    path and up to ``most`` children of each node on it are held. One task reads the parts that ranges share: at most the
    turns of every range's first and last key. The ends of one node are hashed in order, as SHA-256 needs it, in chunks.
    """

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = runs(((bytes.fromhex("".join(turns)), ident) for ident, turns in _rows(batches)), run, block)
        return _batched(made, _BLOCK_ROW, lambda row: 256 + sum(map(len, row[5])) + 16 * len(row[6]), 4 * block)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        return _batched(path_nodes(merged(_rows(batches)), piece, chunk, most), _FOUND_ROW, lambda row: 1 + len(row.get("chunk") or "") // 64, BATCH)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = (row for batch in batches for row in batch.to_pylist())
        return _batched(joined_parts(parts), _FOUND_ROW, lambda row: 1, BATCH)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple[bytes, str]]:
            key, sha = None, None
            for k, text in _rows(batches):
                if k != key:
                    if sha:
                        yield key, sha.hexdigest()
                    key, sha = k, hashlib.sha256(text.encode())
                else:
                    sha.update(b"," + text.encode())
            if sha:
                yield key, sha.hexdigest()

        return _batched(each(), pa.schema([("key", pa.binary()), ("digest", pa.string())]), lambda row: 1, BATCH)

    with bounded(found.sparkSession):
        # hex digits in order are bytes in order, and a shorter list comes before those that go on
        dealt = found.select("conv_id", "turns").repartitionByRange("turns", "conv_id")
        blocks = dealt.mapInArrow(make_runs, BLOCKS).sortWithinPartitions(F.col("after").asc_nulls_first(), F.col("after_id").asc_nulls_first(), "run")
        rows = cut(blocks.mapInArrow(merge, FOUND))
        parts = rows.where("kind = 'part'").coalesce(1).sortWithinPartitions("piece", "place")
        open_ = cut(parts.mapInArrow(join, FOUND))
        ends = rows.where("kind = 'ends'").repartition("key").sortWithinPartitions("key", "piece", "place").select("key", "chunk")
        digests = cut(ends.mapInArrow(digest, "key binary, digest string"))
    nodes = rows.where("kind = 'node'")
    settled = "parent IS NULL AND ends_sha256 IS NOT NULL"
    late = nodes.where(f"NOT ({settled})").union(open_)
    names = nodes.union(open_).where("key IS NOT NULL").select(F.col("key").alias("parent"), F.col("conv_id").alias("named"))
    late = late.join(names, "parent", "left").join(digests, "key", "left").withColumns({"parent_conv_id": F.coalesce("parent_conv_id", "named"), "ends_sha256": F.coalesce("digest", "ends_sha256", F.lit(EMPTY))})
    columns = "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    return nodes.where(settled).select(*columns).union(late.select(*columns))


SQL = """
WITH t AS (SELECT conv_id, turn, length(coalesce(text, '')) AS chars, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, k, chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS n FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS hub, xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
        lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) % 6 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, o.n, k, chars FROM c JOIN o ON o.conv_id = c.hub AND o.n <= c.h
    UNION ALL SELECT c.conv_id, 1, o.n, k, chars FROM c JOIN o ON o.conv_id = c.conv_id AND o.n > c.h),
m AS (SELECT conv_id, row_number() OVER w AS depth, string_agg(k, '') OVER w AS path, chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, n)
    UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM m GROUP BY path, depth),
k AS (SELECT left(path, 64 * (depth - 1)::BIGINT) AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
e AS (SELECT path, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ends FROM (SELECT conv_id, arg_max(path, depth) AS path FROM m GROUP BY conv_id) GROUP BY path),
s AS (SELECT m.path, sum((n.n_convs - 1) * n.chars) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
    FROM n JOIN m ON m.conv_id = n.conv_id AND m.depth <= n.depth LEFT JOIN k ON k.path = n.path GROUP BY m.path)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN e USING (path) LEFT JOIN n AS p ON n.depth > 0 AND p.path = left(n.path, 64 * (n.depth - 1)::BIGINT) AND p.depth = n.depth - 1
"""
