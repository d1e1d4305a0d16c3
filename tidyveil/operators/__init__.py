"""Table operators: each takes a DataFrame and gives a DataFrame."""

from tidyveil.operators.cleaning import (
    remove_duplicates,
    remove_empty_columns,
    remove_empty_rows,
    trim_whitespace,
)
from tidyveil.operators.filters import filter_rows, search_rows
from tidyveil.operators.grouping import generalize_column, revenue_bands, suppress_low_counts
from tidyveil.operators.missing import fill_missing
from tidyveil.operators.normalize import (
    normalize_booleans,
    normalize_dates,
    normalize_numbers,
    replace_values,
)
from tidyveil.operators.paging import page, page_count, preview
from tidyveil.operators.privacy import (
    hash_column,
    mask_column,
    pseudonymize_column,
    redact_column,
)
from tidyveil.operators.projection import (
    drop_placeholder_columns,
    remove_columns,
    rename_columns,
    reorder_columns,
    select_columns,
)

__all__ = [
    "drop_placeholder_columns", "fill_missing", "filter_rows", "generalize_column", "hash_column",
    "mask_column", "normalize_booleans", "normalize_dates", "normalize_numbers", "page", "page_count",
    "preview", "pseudonymize_column", "redact_column", "remove_columns", "remove_duplicates",
    "remove_empty_columns", "remove_empty_rows", "rename_columns", "reorder_columns",
    "replace_values", "revenue_bands", "search_rows", "select_columns", "suppress_low_counts",
    "trim_whitespace",
]
