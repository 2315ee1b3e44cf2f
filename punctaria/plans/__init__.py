"""Named queries and their SQL."""

from . import point_queries, region_queries, table_queries  # noqa: F401  they register themselves
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
