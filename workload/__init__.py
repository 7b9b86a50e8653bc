"""The registered queries: every operator on the driver's tables, with its oracle SQL."""

from workload.registry import ORACLES, QUERIES
from workload import products, relational, spatial, storage, streams, temporal  # noqa: F401

__all__ = ["ORACLES", "QUERIES"]
