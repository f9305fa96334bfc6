"""fillcast: fill-level time-series analytics and forecasting as PySpark jobs."""

from fillcast.config import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings"]
