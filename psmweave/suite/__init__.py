"""Registered queries: every operator applied to the driver's tables."""

from psmweave.suite import (  # noqa: F401  (importing registers the queries)
    q_compare,
    q_curves,
    q_evidence,
    q_joins,
    q_models,
    q_projections,
    q_sources,
    q_summary,
)
from psmweave.suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
