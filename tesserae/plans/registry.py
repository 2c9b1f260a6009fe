"""All queries and their DuckDB equivalents."""

from tesserae.plans import array_queries, scene_queries, time_queries, tree_queries

QUERIES = time_queries.QUERIES | tree_queries.QUERIES | array_queries.QUERIES | scene_queries.QUERIES
ORACLES = time_queries.ORACLES | tree_queries.ORACLES | array_queries.ORACLES | scene_queries.ORACLES
