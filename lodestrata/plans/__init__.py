"""Registered queries over the driver's tables, and their DuckDB twins."""

from . import aggregates, changes, scans, searches, state, stored, texts
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "aggregates", "changes", "scans", "searches", "state", "stored", "texts"]
