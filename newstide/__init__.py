"""News sentiment against daily price moves, on Spark DataFrames."""

from newstide.plans.engine import NewsEngine

__all__ = ["NewsEngine"]
