"""Mixing sources to target weights by hash-threshold histograms, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cinefold.llm.common import cut, n_words

#: A document's place in its source: the first 60 bits of an MD5, dealt in levels of 12 bits.
HASH_BITS, LEVEL_BITS = 60, 12
#: Most sources whose plan, a row each, is broadcast; with more, it is joined as any table.
BROADCAST_ROWS = 100_000


def small(plan: DataFrame) -> DataFrame:
    """The plan, marked for broadcast if its rows, counted here, are few: else a hot source would be one task's."""
    return F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan


def place(ident: Column, text: Column) -> Column:
    """A document's hash, in [0, 2**60): of its id, or of its text where the id is null."""
    return F.conv(F.substring(F.md5(F.coalesce(ident.cast("string"), F.md5(text), F.lit(""))), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(key, source_size, target) from (key, source_size): shares by weight, none above ``most`` times its size.

    The weights repeat over the keys in order. Filling in order of size over weight finds the level at which resharing
    the excess ends: a source whose bound lies under the level of those from it on is bounded. One row a source, so
    the windows hold as many rows as there are sources.
    """
    order, filled = W.orderBy("key"), W.orderBy("ratio", "key")
    before, onward = filled.rowsBetween(W.unboundedPreceding, -1), filled.rowsBetween(W.currentRow, W.unboundedFollowing)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", weight)
        .withColumn("bound", most * F.col("source_size"))
        .withColumn("ratio", F.col("bound") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.lit(share) * F.col("total") - F.coalesce(F.sum("bound").over(before), F.lit(0))) / F.sum("weight").over(onward))
        .withColumn("level", F.min(F.when(F.col("bound") > F.col("level") * F.col("weight"), F.struct("ratio", "key", "level"))).over(W.partitionBy())["level"])
        .select("key", "source_size", F.coalesce(F.least(F.col("bound").cast("double"), F.col("level") * F.col("weight")), F.col("bound").cast("double")).alias("target"))
    )


def thresholds(sized: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """(key, source_size, target, rounds, threshold) from (key, size, place) rows.

    Every document is taken ``rounds`` times, and once more if its place is under the threshold. The words of each
    source are summed by the leading bits of the place; the bucket in which the rest of the budget ends is alone summed
    again by its next bits, until it holds one place. It is taken if that comes nearer the target.
    """
    plan = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")), weights, share, most)
    plan = cut(
        plan.withColumn("rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("left", F.col("target") - F.col("rounds") * F.col("source_size"))
        .withColumns({"low": F.lit(0).cast("long"), "span": F.lit(0).cast("long"), "held": F.lit(0).cast("long"), "places": F.lit(0).cast("long")})
    )
    done = 0
    while done < HASH_BITS:
        done += LEVEL_BITS
        inside = sized if done == LEVEL_BITS else sized.join(
            small(plan.where("places > 1").select("key", "low", "span")), "key"
        ).where("place >= low AND place < low + span").select("key", "size", "place")
        summed = inside.groupBy("key", F.shiftright("place", HASH_BITS - done).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("place").alias("first"), F.max("place").alias("last"))
        upto = summed.withColumn("upto", F.sum("words").over(W.partitionBy("key").orderBy("bucket")))
        ends = (
            upto.join(plan.select("key", "left"), "key")
            .where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")))
            .select("key", "bucket", "words", (F.col("left") - F.col("upto") + F.col("words")).alias("rest"), (F.col("first") < F.col("last")).alias("more"))
        )
        now = {
            "left": "rest", "held": "words",
            "low": F.shiftleft("bucket", HASH_BITS - done), "span": F.lit(2 ** (HASH_BITS - done)),
            "places": F.when(F.col("more"), 2).otherwise(1),
        }
        step = plan.join(ends, "key", "left").withColumns({c: F.when(F.col("bucket").isNotNull(), v if isinstance(v, Column) else F.col(v)).otherwise(F.col(c)) for c, v in now.items()})
        plan = cut(step.select(*plan.columns))
        if plan.where("places > 1").isEmpty():
            break
    ending = F.col("low") + F.when(2 * F.col("left") >= F.col("held"), F.col("span")).otherwise(0)
    return plan.select("key", "source_size", "target", "rounds", ending.alias("threshold"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, ident: str = "doc_id", text: str = "text", source: str = "source", narrow: bool = False) -> DataFrame:
    """All documents with size, source_size, target and taken (words the mix takes, repeats counted).

    ``narrow`` returns the id and these four alone, and reads the texts once. The sources, by code point with null last,
    have the weights in turn and share ``share`` times all words. Null or empty texts have size 0 and are never taken;
    rows with equal ids are taken alike; other columns are carried as they are, though columns named as the five added
    ones are replaced. An empty table gives no rows.
    """
    key = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    work = {"_mix_key": key, "_mix_size": n_words(text), "_mix_place": place(F.col(ident), F.col(text))}
    sized = cut(docs.select(ident, *[c.alias(n) for n, c in work.items()]))
    plan = thresholds(sized.select(F.col("_mix_key").alias("key"), F.col("_mix_size").alias("size"), F.col("_mix_place").alias("place")), weights, share, most)
    plan = plan.select(F.col("key").alias("_mix_key"), *[F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "rounds", "threshold")])
    rows = sized if narrow else docs.withColumns(work)
    taken = F.col("_mix_size") * (F.col("_mix_rounds") + (F.col("_mix_place") < F.col("_mix_threshold")).cast("long"))
    added = {"size": F.col("_mix_size"), "source_size": F.col("_mix_source_size"), "target": F.col("_mix_target"), "taken": taken}
    out = rows.join(small(plan), "_mix_key").withColumns(added)
    return out.drop(*[c for c in out.columns if c.startswith("_mix_")])


SQL = r"""
WITH sized AS (
    SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS key,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
           ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15))::BIGINT AS place
    FROM documents),
sizes AS (SELECT key, sum(size)::BIGINT AS source_size FROM sized GROUP BY key),
weighed AS (
    SELECT key, source_size, 2 * source_size AS bound, [3, 1, 2][((row_number() OVER (ORDER BY key)) - 1) % 3 + 1] AS weight,
           sum(source_size) OVER () AS total FROM sizes),
levels AS (
    SELECT *, bound / weight AS ratio,
           (1.5::DOUBLE * total - coalesce(sum(bound) OVER (ORDER BY bound / weight, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
           / sum(weight) OVER (ORDER BY bound / weight, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
level AS (SELECT arg_min(level, {'r': ratio, 'k': key}) AS level FROM levels WHERE bound > level * weight),
targets AS (
    SELECT key, source_size, coalesce(least(bound::DOUBLE, level.level * weight), bound::DOUBLE) AS target FROM levels LEFT JOIN level ON true),
budget AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM targets),
places AS (
    SELECT key, place, sum(size)::BIGINT AS words, sum(sum(size)) OVER (PARTITION BY key ORDER BY place) AS upto FROM sized GROUP BY key, place),
ends AS (
    SELECT p.key, p.place + (2 * (b.target - b.rounds * b.source_size - p.upto + p.words) >= p.words)::BIGINT AS threshold
    FROM places p JOIN budget b ON p.key = b.key
    WHERE p.upto > b.target - b.rounds * b.source_size AND p.upto - p.words <= b.target - b.rounds * b.source_size)
SELECT s.doc_id, s.size, b.source_size, b.target, s.size * (b.rounds + (s.place < coalesce(e.threshold, 0))::BIGINT) AS taken
FROM sized s JOIN budget b ON s.key = b.key LEFT JOIN ends e ON s.key = e.key
"""
