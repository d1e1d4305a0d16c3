"""Looking at part of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.constants import PAGE_SIZES, PREVIEW_ROWS
from tidyveil.errors import StepError
from tidyveil.functions.columns import need_flat, ref
from tidyveil.operators.ordering import row_numbers_between

TOP_K_ROWS = 10_000


def preview(df: DataFrame, max_rows: int = PREVIEW_ROWS, order_by: list[str] | None = None) -> DataFrame:
    """The first rows; which ones they are is settled only with ``order_by``."""
    return (df.orderBy(*map(ref, order_by)) if order_by else df).limit(max_rows)


def page_count(rows: int, page_size: int) -> int:
    return max(1, -(-rows // page_size))


def page(df: DataFrame, number: int, page_size: int, order_by: list[str]) -> tuple[DataFrame, int]:
    """Page ``number`` (from 0) in ``order_by``, and how many pages there are.

    A number out of range gives the first page. Early pages are a top-k; later ones sort only the
    stretch of the table they lie in, so a page deep in a huge table costs no global sort.
    """
    if page_size not in PAGE_SIZES:
        raise StepError(f"page_size must be one of {PAGE_SIZES}")
    if not order_by:
        raise StepError("paging needs order_by")
    for name in order_by:
        need_flat(df, name)
    count = df.count()
    pages = page_count(count, page_size)
    number = number if 0 <= number < pages else 0
    first, last = number * page_size + 1, (number + 1) * page_size
    if last <= TOP_K_ROWS:
        tie = F.xxhash64(*map(ref, df.columns))
        rows = df.orderBy(*map(ref, order_by), tie).offset(first - 1).limit(page_size)
    else:
        rows = row_numbers_between(df, order_by, first, last, count).orderBy("__row_number").drop("__row_number")
    return rows, pages
