"""Queries over the given tables, one or more per operator, with oracle SQL."""

from workload import code, diffs, files, texts  # noqa: F401
from workload.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
