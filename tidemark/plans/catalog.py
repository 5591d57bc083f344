"""All queries and their SQL."""

from . import queries_cards, queries_graph, queries_listening, queries_models, queries_more, queries_plans, queries_sets  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
