"""Every registered query of the library, with the SQL it is checked against."""

from __future__ import annotations

from cinefold.plans import arrays, costs, edits, embeddings, forests, grids, models, pairwise, sequences, shapes, streams, synthesis, tables, volumes

_MODULES = (pairwise, sequences, arrays, costs, tables, shapes, synthesis, edits, models, grids, embeddings, volumes, forests, streams)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
