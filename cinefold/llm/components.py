"""Connected components, by the library's contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cinefold.operators.graph import FEW, components, united

__all__ = ["connected_components", "united"]


def connected_components(edges: DataFrame, native: bool = False) -> DataFrame:
    """(node, component) of every node on an edge (a, b); component is the smallest node reachable.

    With ``native`` only DataFrame operations are used, also when few edges are left.
    """
    return components(edges, 0 if native else FEW)
