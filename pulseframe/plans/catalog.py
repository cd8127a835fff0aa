"""All checked queries, filled by importing their modules."""

from pulseframe.plans import q_clean, q_model, q_report  # noqa: F401
from pulseframe.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
