"""Named queries over the standard tables, each with the same query in ANSI SQL."""

from . import programs, records, verbs  # noqa: F401  register their queries
from .catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
