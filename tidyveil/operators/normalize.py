"""Type normalization and text replacement, one column at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.functions.columns import has_column, need_flat, ref, replace_column, text_column
from tidyveil.functions.parsing import parse_boolean, spark_date_pattern, with_moment, with_number
from tidyveil.functions.patterns import java_pattern, java_replacement


def normalize_dates(df: DataFrame, column: str, output_format: str = "%Y-%m-%d") -> DataFrame:
    """Dates in mixed styles as text in one style; what is no date becomes NULL."""
    if not has_column(df, column):
        return df
    pattern = spark_date_pattern(output_format)
    return replace_column(with_moment(df, column), column, F.date_format(ref(column), pattern))


def normalize_numbers(df: DataFrame, column: str) -> DataFrame:
    """Money, percentages and bracketed negatives as doubles; what is no number becomes NULL."""
    if not has_column(df, column):
        return df
    return with_number(df, column)


def normalize_booleans(df: DataFrame, column: str) -> DataFrame:
    """Yes / no spellings as booleans; anything else becomes NULL."""
    if not has_column(df, column):
        return df
    return replace_column(df, column, parse_boolean(ref(column), need_flat(df, column)))


def replace_values(df: DataFrame, column: str, old_value: str, new_value: str, regex: bool = False) -> DataFrame:
    """Replace every occurrence of ``old_value`` inside the column's text. Missing cells stay missing."""
    if not has_column(df, column):
        return df
    text = text_column(df, column)
    if regex:
        changed = F.regexp_replace(text, java_pattern(old_value), java_replacement(new_value))
    elif old_value == "":
        changed = F.regexp_replace(text, "", java_replacement(new_value.replace("\\", "\\\\")))
    else:
        changed = F.replace(text, F.lit(old_value), F.lit(new_value))
    return replace_column(df, column, changed)
