"""Queries over the provided tables and their SQL."""

from quillon.plans import cells, graphs, ordered, programs, scoring  # noqa: F401  they register their queries
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
