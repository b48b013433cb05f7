"""Queries on classifiers of frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import forest
from cinefold.plans.pairwise import frames

#: Features, trees, levels below the root, and the fewest rows that are split.
WIDTH, TREES, DEPTH, LEAST = 4, 3, 3, 8


def _marked(spark: SparkSession, sf_dir: str, key: F.Column, positive: F.Column) -> DataFrame:
    return frames(spark, sf_dir).select(key.alias("key"), F.col("frame").alias("id"), "label", F.transform("pixels", lambda x: x.cast("double")).alias("features"), positive.alias("positive"))


def matte_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of trees that tell frames of even labels from others."""
    rows = _marked(spark, sf_dir, F.lit(0), F.col("label") % 2 == 0)
    return forest.grow(rows, WIDTH, TREES, DEPTH, LEAST).drop("key").withColumn("threshold", F.round("threshold", 9))


def matte(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely a frame has an even label, and the hard decision."""
    rows = _marked(spark, sf_dir, F.lit(0), F.col("label") % 2 == 0)
    found = forest.probabilities(rows, forest.grow(rows, WIDTH, TREES, DEPTH, LEAST), DEPTH)
    return found.select(F.col("id").alias("frame"), F.round("probability", 9).alias("probability"), (F.col("probability") > 0.5).alias("inside"))


def model_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model a label against all others; the share of every label's frames that it takes for its own."""
    rows = frames(spark, sf_dir)
    labels = F.broadcast(rows.groupBy().agg(F.array_sort(F.collect_set("label")).alias("all")))  # one row: its length is the number of labels
    each = rows.join(labels).select("*", F.explode("all").alias("key"))
    each = each.select("key", F.col("frame").alias("id"), "label", F.transform("pixels", lambda x: x.cast("double")).alias("features"), (F.col("label") == F.col("key")).alias("positive"))
    found = forest.probabilities(each, forest.grow(each, WIDTH, TREES, DEPTH, LEAST), DEPTH)
    share = found.join(rows.select(F.col("frame").alias("id"), "label"), "id").groupBy(F.col("key").alias("model"), "label")
    return share.agg(F.count("*").alias("n"), F.round(F.avg("probability"), 6).alias("similarity"))


QUERIES = {f.__name__: f for f in (matte_trees, matte, model_similarity)}


def _level(k: int) -> str:
    """SQL tables of one level: rows ``r``, their nodes ``n``, each feature's cut ``c``, the best of them ``b``."""
    rows = ("SELECT key, id, tree, 1::BIGINT AS node, e, p FROM m, range({t}) t(tree)".format(t=TREES) if not k else
            f"SELECT r.key, id, r.tree, 2 * r.node + CASE WHEN e[f + 1] > cut THEN 1 ELSE 0 END AS node, e, p FROM r{k - 1} r JOIN b{k - 1} b ON b.key = r.key AND b.tree = r.tree AND b.node = r.node")
    same = "c.key = r.key AND c.tree = r.tree AND c.node = r.node"
    pure = lambda n, p: f"CASE WHEN {n} > 0 THEN (({p}) * ({p}) + ({n} - ({p})) * ({n} - ({p})))::DOUBLE / ({n}) ELSE 0 END"
    return f"""
    r{k} AS MATERIALIZED ({rows}),
    n{k} AS MATERIALIZED (SELECT key, tree, node, count(*) AS n, sum(p)::BIGINT AS p FROM r{k} GROUP BY ALL),
    c{k} AS MATERIALIZED (SELECT *, low + (('0x' || md5('0:' || tree || ':' || node || ':' || f)[:8])::BIGINT / 4294967296::DOUBLE) * (high - low) AS cut FROM
        (SELECT r.key, r.tree, r.node, f, any_value(n.n) AS n, any_value(n.p) AS p, min(e[f + 1]) AS low, max(e[f + 1]) AS high FROM r{k} r JOIN n{k} n ON n.key = r.key AND n.tree = r.tree AND n.node = r.node, range({WIDTH}) f(f)
         WHERE n.p > 0 AND n.p < n.n AND n.n >= {LEAST} GROUP BY r.key, r.tree, r.node, f) WHERE high > low),
    s{k} AS (SELECT c.key, c.tree, c.node, c.f, any_value(cut) AS cut, any_value(c.n) AS n, any_value(c.p) AS p, count(*) FILTER (e[c.f + 1] <= cut) AS ln, coalesce(sum(r.p) FILTER (e[c.f + 1] <= cut), 0)::BIGINT AS lp
        FROM c{k} c JOIN r{k} r ON {same} GROUP BY c.key, c.tree, c.node, c.f),
    b{k} AS MATERIALIZED (SELECT key, tree, node, f, cut FROM s{k} {'' if k < DEPTH else 'WHERE false'} QUALIFY row_number() OVER (PARTITION BY key, tree, node ORDER BY round({pure('ln', 'lp')} + {pure('(n - ln)', 'p - lp')}, 9) DESC, f) = 1)"""


def _grown(marked: str) -> str:
    """SQL tables of all levels, the nodes ``t`` and each row's leaves ``l``, from marked rows ``m``."""
    each = lambda what: " UNION ALL ".join(what(k) for k in range(DEPTH + 1))
    nodes = each(lambda k: f"SELECT n.*, b.f, b.cut FROM n{k} n LEFT JOIN b{k} b ON b.key = n.key AND b.tree = n.tree AND b.node = n.node")
    leaves = each(lambda k: f"SELECT r.key, r.id, n.p / n.n AS share FROM r{k} r JOIN t n ON n.key = r.key AND n.tree = r.tree AND n.node = r.node WHERE n.f IS NULL")
    return f"""WITH m AS MATERIALIZED ({marked}), {','.join(map(_level, range(DEPTH + 1)))}, t AS MATERIALIZED ({nodes}), l AS ({leaves})"""


_EVEN = "SELECT 0 AS key, vec_id AS id, embedding::DOUBLE[] AS e, (label % 2 = 0)::INTEGER AS p FROM embeddings"
_EACH = "SELECT k.label AS key, vec_id AS id, embedding::DOUBLE[] AS e, (x.label = k.label)::INTEGER AS p FROM embeddings x, (SELECT DISTINCT label FROM embeddings) k"

ORACLE_SQL = {
    "matte_trees": f"{_grown(_EVEN)} SELECT tree::INTEGER AS tree, node, n, p AS positives, f::INTEGER AS feature, round(cut, 9) AS threshold FROM t",
    "matte": f"{_grown(_EVEN)} SELECT id AS frame, round(avg(share), 9) AS probability, avg(share) > 0.5 AS inside FROM l GROUP BY id",
    "model_similarity": f"""{_grown(_EACH)}, a AS (SELECT key, id, avg(share) AS probability FROM l GROUP BY key, id)
        SELECT key AS model, label, count(*) AS n, round(avg(probability), 6) AS similarity FROM a JOIN embeddings ON vec_id = id GROUP BY key, label""",
}
