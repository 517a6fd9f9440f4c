"""Registered queries: every operator applied to the test tables, with its SQL counterpart."""

from tidemark.catalog import evaluation, gaps_and_joins, loading, modelling, profiles, scalars, series  # noqa: F401
from tidemark.catalog.base import QUERIES, oracle_sql, queries

__all__ = ["QUERIES", "oracle_sql", "queries"]
