"""The checked queries over the sample tables."""

from traitlens.catalog import attributions, jobs, models, searches, statistics, tables  # noqa: F401
from traitlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
