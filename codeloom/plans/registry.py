"""All named queries of the library."""

from codeloom.plans import code_queries, graph_queries, symbol_queries, text_queries  # noqa: F401
from codeloom.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
