"""All registered queries of the sales model and their oracles."""

from .grid_queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
