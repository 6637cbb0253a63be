"""Everything registered, in one place."""

from maskwright.plans import feeds, histories, measures, pages, redaction, scoring  # noqa: F401
from maskwright.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
