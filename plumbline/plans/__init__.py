"""Fixture views, and the registered queries with their SQL."""

from plumbline.plans import coverages, scenes, whole  # noqa: F401
from plumbline.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
