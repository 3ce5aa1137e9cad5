"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from emberline.plans import fire_queries, grid_queries, model_queries, point_queries, tile_queries

_PARTS = (point_queries, grid_queries, fire_queries, tile_queries, model_queries)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
