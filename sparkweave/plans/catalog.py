"""All queries of the graph engine over the driver's tables."""

from sparkweave.plans import index_queries, piece_queries  # noqa: F401  register their queries
from sparkweave.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
