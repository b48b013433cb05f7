"""Queries over sparse arrays, with their SQL: ship days of the year by quantities, from two sets of counts over lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinefold.operators import sparse
from cinefold.session import table

_DEFAULTS = {"add": (0, 3), "sub": (0, 3), "mul": (2, 3), "div": (1, 3), "truediv": (1, 3), "floordiv": (7, 3), "mod": (-7, 3), "pow": (2, 2)}

#: Days of a year and quantities, with 0.
SHAPE = (367, 51)


def _pair(spark: SparkSession, sf_dir: str, defaults: tuple[float, float]) -> tuple[sparse.Sparse, sparse.Sparse]:
    """Lines by ship day of the year and quantity, returned ones and others: two arrays whose cells are where lines are."""
    lines = table(spark, sf_dir, "lineitem").select(F.array(F.dayofyear("l_shipdate"), F.col("l_quantity").cast("int")).alias("idx"), (F.col("l_returnflag") == "R").alias("back"))
    counts = lines.groupBy("idx").agg(F.count_if("back").alias("one"), F.count_if(~F.col("back")).alias("two"))
    cells = lambda c, most: counts.where(f"{c} > 0").select("idx", (F.col(c) % most + 1).cast("double").alias("value"))
    return sparse.Sparse(cells("one", 10), SHAPE, defaults[0]), sparse.Sparse(cells("two", 4), SHAPE, defaults[1])


def _binary(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = sparse.combine(*_pair(spark, sf_dir, _DEFAULTS[name]), name)
        return out.cells.select(F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), F.round("value", 6).alias("value"))

    query.__name__ = f"sparse_{name}"
    return query


def sparse_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.total(_pair(spark, sf_dir, (2, 3))[0])


def sparse_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sparse.dense(_pair(spark, sf_dir, (2, 3))[1]).select(F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), "value")


def sparse_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _pair(spark, sf_dir, (2, 3))
    return sparse.delete(one, two.cells).cells.select(F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), "value")


def sparse_iadd_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sparse.combine_in_place(*_pair(spark, sf_dir, (2, 3)), "add")
    return out.cells.select(F.col("idx")[0].alias("i"), F.col("idx")[1].alias("j"), "value")


QUERIES = {f"sparse_{name}": _binary(name) for name in _DEFAULTS} | {f.__name__: f for f in (sparse_sum, sparse_dense, sparse_delete, sparse_iadd_legacy)}

_CELLS = """
    l AS (SELECT dayofyear(l_shipdate) AS i, l_quantity::INTEGER AS j, l_returnflag = 'R' AS back FROM lineitem),
    a AS (SELECT i, j, (count(*) % 10 + 1)::DOUBLE AS x FROM l WHERE back GROUP BY i, j),
    b AS (SELECT i, j, (count(*) % 4 + 1)::DOUBLE AS y FROM l WHERE NOT back GROUP BY i, j)"""
_SQL = {"add": "{x} + {y}", "sub": "{x} - {y}", "mul": "{x} * {y}", "div": "{x} / {y}", "truediv": "{x} / {y}", "floordiv": "floor({x} / {y})", "mod": "{x} - {y} * floor({x} / {y})", "pow": "pow({x}, {y})"}


def _sql(name: str) -> str:
    x, y = (f"coalesce({c}, {d}::DOUBLE)" for c, d in zip("xy", _DEFAULTS[name], strict=True))
    return f"WITH {_CELLS} SELECT i::INTEGER AS i, j::INTEGER AS j, round({_SQL[name].format(x=x, y=y)}, 6) AS value FROM a FULL JOIN b USING (i, j)"


ORACLE_SQL = {f"sparse_{name}": _sql(name) for name in _DEFAULTS} | {
    "sparse_sum": f"WITH {_CELLS} SELECT 2.0::DOUBLE * {SHAPE[0] * SHAPE[1]} + coalesce(sum(x - 2), 0) AS total FROM a",
    "sparse_dense": f"WITH {_CELLS} SELECT g.i::INTEGER AS i, h.j::INTEGER AS j, coalesce(b.y, 3.0) AS value FROM range({SHAPE[0]}) g(i) CROSS JOIN range({SHAPE[1]}) h(j) LEFT JOIN b ON b.i = g.i AND b.j = h.j",
    "sparse_delete": f"WITH {_CELLS} SELECT a.i::INTEGER AS i, a.j::INTEGER AS j, x AS value FROM a ANTI JOIN b ON a.i = b.i AND a.j = b.j",
    "sparse_iadd_legacy": f"WITH {_CELLS} SELECT i::INTEGER AS i, j::INTEGER AS j, coalesce(x, 5.0) + coalesce(y, 3.0) AS value FROM a FULL JOIN b USING (i, j)",
}
