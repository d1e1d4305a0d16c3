"""A row order for tables that come from files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.constants import ROW_ORDER

__all__ = ["ROW_ORDER", "with_row_id"]


def with_row_id(df: DataFrame) -> DataFrame:
    """Add ``__file``, ``__block``, ``__row_id``: sorted by these three, rows stand as in the files.

    Give them as ``order_by`` to steps that need an order. The id alone is no file order, as Spark
    packs file splits into tasks by size. Call it on the table as read, before any other operator.
    """
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__row_id"),
    )
