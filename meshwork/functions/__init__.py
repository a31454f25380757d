"""Scalar and aggregate functions by name, as builders of Spark columns."""

from meshwork.functions.aggregates import AGGREGATES
from meshwork.functions.scalars import SCALARS, Context

__all__ = ["AGGREGATES", "SCALARS", "Context"]
