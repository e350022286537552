"""The registered queries; importing this package registers them."""

from . import flow, graph, relational, retrieval, service, trees, upkeep
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flow", "graph", "relational", "retrieval", "service", "trees", "upkeep"]
