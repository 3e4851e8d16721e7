"""The registered queries with their SQL, over the given tables."""

from .registry import QUERIES, SQL
from . import basic, models, reports, series  # noqa: F401  (each registers its queries)

__all__ = ["QUERIES", "SQL"]
