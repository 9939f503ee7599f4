"""The registered queries, by topic."""

from korridor.plans import analytics, contracts, decisions, delivery, fused, integrity, models, quality, relational, scalars, windows  # noqa: F401
from korridor.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
