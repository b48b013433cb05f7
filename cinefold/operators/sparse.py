"""Sparse arrays: (idx, value) rows with a default value and a shape that the caller holds."""

from __future__ import annotations

from math import prod
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Sparse(NamedTuple):
    """Cells that differ from the default; ``idx`` is an array of as many integers as the shape has dimensions."""

    cells: DataFrame
    shape: tuple[int, ...]
    default: float = 0.0


def _modulo(a: Column, b: Column) -> Column:
    return a - b * F.floor(a / b)


#: The result's sign of a modulo follows the divisor; dividing by zero is an error, as is a zero default divisor.
OPERATIONS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    "div": lambda a, b: a / b,
    "truediv": lambda a, b: a / b,
    "floordiv": lambda a, b: F.floor(a / b).cast("double"),
    "mod": _modulo,
    "pow": lambda a, b: F.pow(a, b),
}
_PLAIN = {
    "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / b,
    "truediv": lambda a, b: a / b, "floordiv": lambda a, b: float(a // b), "mod": lambda a, b: a % b, "pow": lambda a, b: a**b,
}


def combine(a: Sparse, b: Sparse, operation: str) -> Sparse:
    """The operation over the union of keys, each side's missing cells standing for its default."""
    if a.shape != b.shape:
        raise ValueError(f"shapes differ: {a.shape} and {b.shape}")
    left, right = a.cells.select("idx", F.col("value").alias("x")), b.cells.select("idx", F.col("value").alias("y"))
    x, y = F.coalesce("x", F.lit(float(a.default))), F.coalesce("y", F.lit(float(b.default)))
    if operation in ("div", "truediv", "floordiv", "mod"):
        y = F.when(y == 0, F.raise_error(F.lit("division by zero")).cast("double")).otherwise(y)
        if b.default == 0:
            raise ZeroDivisionError("the divisor's default is zero")
    cells = left.join(right, "idx", "full_outer").select("idx", OPERATIONS[operation](x, y).alias("value"))
    return Sparse(cells, a.shape, _PLAIN[operation](float(a.default), float(b.default)))


def combine_in_place(a: Sparse, b: Sparse, operation: str) -> Sparse:
    """The legacy in-place form: keys of the right side alone combine with the already combined default."""
    out = combine(a, b, operation)
    left, right = a.cells.select("idx", F.col("value").alias("x")), b.cells.select("idx", F.col("value").alias("y"))
    x = F.coalesce("x", F.lit(float(out.default)))
    y = F.coalesce("y", F.lit(float(b.default)))
    return Sparse(left.join(right, "idx", "full_outer").select("idx", OPERATIONS[operation](x, y).alias("value")), a.shape, out.default)


def total(a: Sparse) -> DataFrame:
    """(total,): the sum over all cells, stored or not."""
    return a.cells.agg((F.lit(float(a.default)) * prod(a.shape) + F.coalesce(F.sum(F.col("value") - a.default), F.lit(0.0))).alias("total"))


def dense(a: Sparse) -> DataFrame:
    """(idx, value) of every cell of the shape."""
    grid = a.cells.sparkSession.range(prod(a.shape))
    parts, rest = [], F.col("id")
    for n in reversed(a.shape):
        parts.append((rest % n).cast("int"))
        rest = F.floor(rest / n)
    grid = grid.select(F.array(*reversed(parts)).alias("idx"))
    return grid.join(a.cells, "idx", "left").select("idx", F.coalesce("value", F.lit(float(a.default))).alias("value"))


def get(a: Sparse, *idx: int) -> Column:
    """A cell's value as an aggregate over the cells; the default where none is stored, inside the shape or not."""
    return F.coalesce(F.max(F.when(F.col("idx") == F.array(*map(F.lit, idx)), F.col("value"))), F.lit(float(a.default)))


def delete(a: Sparse, gone: DataFrame) -> Sparse:
    """Without the given idx rows; missing ones are silent."""
    return a._replace(cells=a.cells.join(gone.select("idx"), "idx", "left_anti"))
