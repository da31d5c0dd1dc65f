"""All registered queries."""

from tidemark.plans import queries_compare, queries_fingerprint, queries_sources  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
