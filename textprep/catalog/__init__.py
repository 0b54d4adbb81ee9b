"""Registered queries: one or more per operator, with SQL oracles."""

from textprep.catalog import feature_queries, file_queries, table_queries, text_queries  # noqa: F401
from textprep.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
