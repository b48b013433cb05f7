"""Extremely randomised trees, grown level by level from sums by node, for many models at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinefold.session import settled

#: Nodes up to which a table of them is broadcast; beyond it, rows are joined by key.
SMALL = 1 << 14
_NODE = ["key", "tree", "node"]


def _small(nodes: DataFrame) -> DataFrame:
    """The nodes, marked for broadcast if a count shows that they are few."""
    return F.broadcast(nodes) if nodes.count() <= SMALL else nodes


def _draw(seed: int, feature: int) -> Column:
    """An even draw from [0, 1) for a node's feature, from the digest of their names."""
    name = F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), F.col("node").cast("string"), F.lit(str(feature)))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / 2.0**32


def grow(rows: DataFrame, width: int, trees: int, depth: int, least: int = 2, seed: int = 0) -> DataFrame:
    """(key, tree, node, n, positives, feature, threshold): each key's trees over (key, features, positive) rows.

    The root is node 1, the children of node k are 2 k (the feature is at most the threshold) and 2 k + 1; a leaf has no
    feature. Each feature of a node gets one threshold, drawn evenly between its least and largest value there; the feature
    that leaves the children purest (Gini, to nine digits) is taken, ties to the smaller one. Nodes of one class, of fewer
    than ``least`` rows, without two different values or at ``depth`` are leaves. Rows with a null in the first ``width``
    features or without a class are left out. A level is two sums by node, made before the shuffle, so a key may hold any
    share of the rows; rows stand once for each tree.
    """
    f = lambda k: F.col("features")[k]
    whole = F.col("positive").isNotNull() & F.forall(F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda k: F.get("features", k)), lambda x: x.isNotNull())
    state = rows.where(whole).select("key", F.transform(F.slice("features", 1, width), lambda x: x.cast("double")).alias("features"), F.col("positive").cast("long").alias("positive"))
    state = settled(state.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("node", F.lit(1).cast("long")))
    levels = []
    for level in range(depth + 1):
        facts = state.groupBy(*_NODE).agg(F.count("*").alias("n"), F.sum("positive").alias("positives"), *[F.min(f(k)).alias(f"low_{k}") for k in range(width)], *[F.max(f(k)).alias(f"high_{k}") for k in range(width)])
        cuts = F.array(*[F.when(F.col(f"high_{k}") > F.col(f"low_{k}"), F.col(f"low_{k}") + _draw(seed, k) * (F.col(f"high_{k}") - F.col(f"low_{k}"))) for k in range(width)])
        facts = settled(facts.select(*_NODE, "n", "positives", cuts.alias("cuts")))
        able = (F.col("positives") > 0) & (F.col("positives") < F.col("n")) & (F.col("n") >= least) & F.exists("cuts", lambda c: c.isNotNull())
        if level == depth:
            levels.append(facts.select(*_NODE, "n", "positives", F.lit(None).cast("int").alias("feature"), F.lit(None).cast("double").alias("threshold")))
            break
        met = state.join(_small(facts.where(able).select(*_NODE, "cuts")), _NODE)
        low = [f(k) <= F.col("cuts")[k] for k in range(width)]
        sums = met.groupBy(*_NODE).agg(F.array(*[F.count_if(c) for c in low]).alias("ln"), F.array(*[F.sum(F.when(c, F.col("positive")).otherwise(0)) for c in low]).alias("lp"))
        both = facts.join(sums, _NODE, "left")
        pure = lambda n, p: F.when(n > 0, (p * p + (n - p) * (n - p)) / n).otherwise(0.0)
        score = [F.when(F.col("cuts")[k].isNotNull(), F.round(pure(F.col("ln")[k], F.col("lp")[k]) + pure(F.col("n") - F.col("ln")[k], F.col("positives") - F.col("lp")[k]), 9)) for k in range(width)]
        best = F.array_max(F.filter(F.array(*[F.struct(s.alias("score"), F.lit(-k).alias("k"), F.col("cuts")[k].alias("cut")) for k, s in enumerate(score)]), lambda s: s["score"].isNotNull()))
        nodes = both.withColumn("best", F.when(F.col("ln").isNotNull(), best))
        nodes = settled(nodes.select(*_NODE, "n", "positives", (-F.col("best.k")).cast("int").alias("feature"), F.col("best.cut").alias("threshold")))
        levels.append(nodes)
        split = nodes.where("feature is not null").select(*_NODE, "feature", "threshold")
        state = settled(state.join(_small(split), _NODE).withColumn("node", 2 * F.col("node") + (F.element_at("features", F.col("feature") + 1) > F.col("threshold")).cast("long")).drop("feature", "threshold"))
        if split.isEmpty():
            break
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return settled(out)


def probabilities(rows: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """(key, id, probability) of (key, id, features) rows, unique by key and id: the mean over a key's trees of the share of positives in the leaf."""
    roots = nodes.where("node = 1").select("key", "tree", "node")
    at = rows.select("key", "id", "features").join(_small(roots), "key")
    table = _small(nodes.select(*_NODE, "n", "positives", "feature", "threshold"))
    for _ in range(depth):
        met = at.join(table, _NODE)
        step = 2 * F.col("node") + (F.element_at("features", F.col("feature") + 1) > F.col("threshold")).cast("long")
        at = met.withColumn("node", F.when(F.col("feature").isNull(), F.col("node")).otherwise(step)).select("id", "features", *_NODE)
    return at.join(table, _NODE).groupBy("key", "id").agg(F.avg(F.col("positives") / F.col("n")).alias("probability"))
