"""Every operator as a query over the given tables, with the SQL that must give the same rows."""

from checks.registry import QUERIES, SQL
from checks import cleaning, files, inspection, privacy, rows, steps, values  # noqa: F401

__all__ = ["QUERIES", "SQL"]
