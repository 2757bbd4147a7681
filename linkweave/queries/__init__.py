"""Queries of the graph and table operators over the given tables; importing this package registers them all."""

from linkweave.queries import alignments, dags, graphs, hierarchies, linkage, metrics, sources, stats, transforms  # noqa: F401
from linkweave.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
