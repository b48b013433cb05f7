"""Near-duplicates by similarity of shingle sets: fast similarity sketches, bands, and a check on the whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.llm import sketches
from cinefold.llm.common import bounded, cut
from cinefold.llm.components import connected_components
from cinefold.llm.sketches import WORDS, differing

#: Per cent of the union that linked sets share.
SIMILAR = 80
#: Bits of a sketch that may differ in pairs that are checked: at similarity 0.8 one differs with a chance of 0.1, so a
#: pair goes beyond with a chance under 2e-11.
APART = 53
#: Most sets in a unit of work, and those that are compared with one at a time.
SHARD, AT_ONCE = 512, 64


def alike(one: np.ndarray, others: list[np.ndarray], similar: int = SIMILAR) -> np.ndarray:
    """Which of some sets that aren't empty are similar enough to one, in whole numbers."""
    sizes = np.fromiter(map(len, others), np.int64, len(others))
    values = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    both = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
    return 100 * both >= similar * (len(one) + sizes - both)


def linked(sets: list[np.ndarray], bits: np.ndarray, label: np.ndarray, similar: int = SIMILAR) -> np.ndarray:
    """The labels, from numbers below the sets', joined where sets are alike; sets of one label aren't compared.

    The nearest sketches come first, some at a time.
    """
    label = label.copy()
    for a in range(len(sets) - 1):
        rest = a + 1 + np.flatnonzero(label[a + 1 :] != label[a])
        away = differing(bits[rest], bits[a])
        rest, away = rest[away <= APART], away[away <= APART]
        rest = rest[np.argsort(away, kind="stable")]
        while len(rest):
            some, rest = rest[:AT_ONCE], rest[AT_ONCE:]
            for b in some[alike(sets[a], [sets[b] for b in some], similar)]:
                if label[a] != label[b]:
                    low, high = sorted((label[a], label[b]))
                    label[label == high] = low
            rest = rest[label[rest] != label[a]]
    return label


def sketched(text: Column, words: int) -> Column:
    """digest (of the set, null if empty), n, bands and bits of every text."""

    @F.pandas_udf("digest binary, n long, bands array<long>, bits array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            rows = []
            for text in batch:
                found = sketches.shingles(text, words)
                values = sketches.sketch(found) if len(found) else None
                marks = (None, None) if values is None else (sketches.bands(values).view(np.int64), sketches.bits(values).view(np.int64))
                rows.append((xxh3_128_digest(found.tobytes()) if len(found) else None, len(found), *marks))
            yield pd.DataFrame(rows, columns=["digest", "n", "bands", "bits"])

    return made(text)


def listed(text: Column, words: int) -> Column:
    """The hashes of a text's shingles, ascending."""

    @F.pandas_udf("array<long>")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([sketches.shingles(x, words).view(np.int64) for x in batch])

    return made(text)


def unit_links(units: DataFrame, similar: int) -> DataFrame:
    """Edges (a, b) that join what alike sets and equal labels join among the rows of each unit (x, i, j).

    Rows have (x, i, j, node, label, bits, found). Links become a star around each group's first set.
    """

    def numbers(column: pa.Array) -> list[np.ndarray]:
        values, at = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        return [values[a:b].view(np.uint64) for a, b in zip(at[:-1], at[1:], strict=True)]

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            nodes = np.array(held[0])
            before = np.unique(np.array(held[1]), return_index=True, return_inverse=True)
            label = linked(held[3], np.array(held[2]), before[1][before[2]], similar)
            moved = label != np.arange(len(nodes))
            return pa.RecordBatch.from_pydict({"a": nodes[moved], "b": nodes[label[moved]]})

        unit, held = None, ([], [], [], [])
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("x", "i", "j", "node", "label")]
            for *at, node, label, bits, found in zip(*columns, *(numbers(batch.column(c)) for c in ("bits", "found")), strict=True):
                if at != unit:
                    if len(held[0]) > 1:
                        yield done()
                    unit, held = at, ([], [], [], [])
                for column, value in zip(held, (node, label, bits.copy(), found.copy()), strict=True):
                    column.append(value)
        if len(held[0]) > 1:
            yield done()

    unit = ["x", "i", "j"]
    return units.repartition(*unit).sortWithinPartitions(*unit, "node").mapInArrow(link, "a long, b long")


def star_links(sets: DataFrame, star: DataFrame, similar: int) -> DataFrame:
    """Edges (a, b) of the pairs in the star whose whole sets are alike; one comparison a pair."""
    one, two = (sets.select(F.col("node").alias(c), F.col("bits").alias(f"{c}_bits"), F.col("found").alias(f"{c}_found")) for c in "ab")
    apart = sum((F.bit_count(F.col("a_bits")[k].bitwiseXOR(F.col("b_bits")[k])) for k in range(WORDS)), F.lit(0))
    sizes = F.size("a_found") + F.size("b_found")
    both = F.size(F.array_intersect("a_found", "b_found"))
    near = star.join(one, "a").join(two, "b").where((apart <= APART) & (100 * F.least(F.size("a_found"), F.size("b_found")) >= similar * F.greatest(F.size("a_found"), F.size("b_found"))))
    return near.where(100 * both >= similar * (sizes - both)).select("a", "b")


def shard_units(banded: DataFrame, shard: int) -> DataFrame:
    """(x, i, j, node, label): the units of bands (node, label, band) in which more than one label meets.

    A band of more than ``shard`` nodes is dealt: nodes outside its most frequent label meet each other and all nodes of
    that label, shard by shard, while the nodes of that label, which are joined already, don't meet among themselves.
    """
    counts = banded.groupBy("band", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("most")).where("low < high")
    dealt = banded.join(mixed, "band").withColumns({"main": F.col("label") == F.col("most.label"), "whole": F.col("n") <= shard})
    parts = lambda n: F.greatest(F.ceil(n / shard), F.lit(1)).cast("int")
    dealt = dealt.withColumns({"p": parts(F.col("most.n")), "q": parts(F.col("n") - F.col("most.n"))})
    own = F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("p")).otherwise(F.col("q"))).cast("int")
    pair = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    each = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    loose = F.concat(each(F.col("q"), lambda o: pair(F.least("own", o), F.greatest("own", o))), each(F.col("p"), lambda m: pair(F.col("q") + m, F.col("own"))))
    main = each(F.col("q"), lambda o: pair(F.col("q") + F.col("own"), o))
    units = F.when(F.col("whole"), F.array(pair(F.lit(0), F.lit(0)))).when(F.col("main"), main).otherwise(loose)
    return dealt.withColumn("own", own).select(F.col("band").alias("x"), "node", "label", F.explode(units).alias("unit")).select("x", "unit.i", "unit.j", "node", "label")


def near_duplicates(docs: DataFrame, ident: str = "doc_id", text: str = "text", words: int = sketches.SHINGLE, similar: int = SIMILAR, shard: int = SHARD) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row: the size of its set, and the smallest id that links reach.

    Copies collapse to one set before anything is compared. Sets that agree in a band are candidates, and a star joins
    each band's members. A group of candidates is one unit of work, in which sets are compared whole. In a group of more
    than ``shard`` sets the stars' pairs are compared first, one by one; after that only bands in which sets aren't
    joined yet are looked at, in units of at most two shards, whatever the size of a band.

    Null and empty texts, and those without words, have an empty set and link with nothing. A row with a null id has its
    group's smallest id, null if there is none, and isn't kept; repeated rows are returned as often as they come. Other
    columns aren't looked at; an empty table gives no rows.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    key = F.struct(F.xxhash64(whole).alias("k1"), F.xxhash64(F.lit(1), whole).alias("k2"))
    with bounded(docs.sparkSession):
        rows = cut(docs.select(F.col(ident).alias("id"), key.alias("key"), sketched(whole, words).alias("h")).select("id", "key", "h.*"))
    classes = rows.where("digest IS NOT NULL").groupBy("digest").agg(F.min("id").alias("least"), F.min("key").alias("key"), F.first("bands").alias("bands"), F.first("bits").alias("bits"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))  # fixed once written

    keyed = classes.select("node", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most").select("band", "b")
    star = cut(keyed.join(shared, "band").where("node <> b").select(F.col("node").alias("a"), "b").distinct())
    groups = cut(connected_components(star))
    big = cut(groups.groupBy("component").count().where(f"count > {shard}").select("component"))

    wanted = classes.join(groups, "node").select("key", "node", "component", "bits")
    texts = docs.select(key.alias("key"), whole.alias("text")).join(wanted, "key")
    texts = texts.groupBy("node").agg(F.first("component").alias("component"), F.first("bits").alias("bits"), F.min("text").alias("text"))
    with bounded(docs.sparkSession):
        sets = cut(texts.select("node", "component", "bits", listed(F.col("text"), words).alias("found")))
        none = F.lit(0)
        small = sets.join(big, "component", "left_anti").select(F.col("component").alias("x"), none.alias("i"), none.alias("j"), "node", F.col("node").alias("label"), "bits", "found")
        edges = [cut(unit_links(small, similar))]
        if not big.isEmpty():
            large = cut(sets.join(big, "component", "left_semi"))
            nodes = large.select("node")
            edges.append(cut(star_links(large, star.join(nodes, star.a == nodes.node, "left_semi"), similar)))
            joined = connected_components(edges[-1])
            labelled = nodes.join(joined, "node", "left").select("node", F.coalesce("component", "node").alias("label"))
            banded = cut(classes.join(labelled, "node").select("node", "label", F.explode("bands").alias("band")))
            units = shard_units(banded, shard).join(large.select("node", "bits", "found"), "node")
            edges.append(cut(unit_links(units, similar)))
    member = connected_components(edges[0].union(edges[1]).union(edges[2]) if len(edges) > 1 else edges[0])

    grouped = cut(classes.join(member, "node", "left").select("digest", "least", F.coalesce("component", "node").alias("component")))
    first = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    named = grouped.join(first, "component").select("digest", "component_id")
    found = rows.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def deduplicate(docs: DataFrame, ident: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of each near-duplicate group's smallest id, with all columns; rows that repeat that id stay."""
    found = near_duplicates(docs.select(ident, text), ident, text, **options).where("kept").select(F.col("id").alias("_kept")).distinct()
    return docs.join(found, docs[ident] == F.col("_kept"), "left_semi")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM w),
d AS (SELECT list_sort(s) AS s, min(doc_id) AS doc_id, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY list_sort(s)),
e AS (SELECT doc_id, n, unnest(s) AS x FROM d),
i AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT a, b FROM i UNION ALL SELECT b, a FROM i),
r AS (SELECT doc_id, doc_id AS node FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT s.doc_id, len(s.s) AS n_shingles, coalesce(c.component_id, s.doc_id) AS component_id, coalesce(c.component_id, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN d ON d.s = list_sort(s.s) AND len(s.s) > 0 LEFT JOIN c ON c.doc_id = d.doc_id
"""
