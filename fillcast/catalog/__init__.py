"""Registered queries: every operator applied to the given tables, with SQL to check it by."""

from fillcast.catalog.registry import REGISTRY
from fillcast.catalog import cleaning, series, weather, splits, metrics, models, studies  # noqa: F401  (registration)

__all__ = ["REGISTRY"]
