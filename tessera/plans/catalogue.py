"""All registered queries and their DuckDB equivalents, gathered from the query modules."""

from __future__ import annotations

from tessera.plans import annotation_queries, argument_queries, model_queries, operator_queries, parse_queries, source_queries, text_queries, training_queries, tree_queries

MODULES = (text_queries, tree_queries, model_queries, annotation_queries, source_queries, operator_queries, training_queries, parse_queries, argument_queries)
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES: dict = {k: q for m in MODULES for k, q in m.ORACLES.items()}
