"""Row predicates. They are plain Column expressions, so Spark can push them into the scan."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.constants import ROW_ORDER
from tidyveil.errors import StepError
from tidyveil.functions.columns import (
    as_text,
    has_column,
    is_fractional,
    is_integral,
    is_nested,
    need_flat,
    ref,
    to_number,
    without_nan,
)
from tidyveil.functions.patterns import java_pattern


def _typed(value: Any, dtype: T.DataType) -> Column:
    """The literal in the column's own type; NULL if it has no such reading."""
    if isinstance(dtype, T.StringType):
        return F.lit(value if isinstance(value, str) else str(value))
    return F.lit(value).try_cast(dtype)


def _ordered(column: Column, dtype: T.DataType, operator: str, value: Any) -> Column:
    try:
        bound = float(value)
    except (TypeError, ValueError) as exc:
        raise StepError(f"{operator} needs a number, got {value!r}") from exc
    if is_integral(dtype) and bound.is_integer() and abs(bound) < 2**53:
        left, right = column, F.lit(int(bound)).cast("bigint")
    else:
        left, right = to_number(column, dtype), F.lit(bound)
    return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[operator]


def filter_rows(df: DataFrame, column: str, operator: str, value: Any, literal: bool = False) -> DataFrame:
    """Keep rows where ``column operator value`` holds.

    ``==`` and ``!=`` compare in the column's type, and ``!=`` keeps missing rows. ``<``, ``<=``,
    ``>`` and ``>=`` compare numbers. ``contains`` and ``not_contains`` look for a pattern in any
    letter case (for plain text with ``literal=True``). An unknown operator changes nothing.
    """
    if not has_column(df, column):
        return df
    c, dtype = ref(column), need_flat(df, column)
    if operator == "==":
        return df.filter(c == _typed(value, dtype))
    if operator == "!=":
        same = without_nan(c, dtype) if is_fractional(dtype) else c
        return df.filter(~F.coalesce(same == _typed(value, dtype), F.lit(False)))
    if operator in ("<", "<=", ">", ">="):
        return df.filter(_ordered(c, dtype, operator, value))
    if operator in ("contains", "not_contains"):
        text = as_text(c, dtype)
        found = (
            F.lower(text).contains(str(value).lower())
            if literal
            else text.rlike("(?iu)" + java_pattern(str(value)))
        )
        return df.filter(found if operator == "contains" else ~F.coalesce(found, F.lit(False)))
    return df


def search_rows(df: DataFrame, query: str) -> DataFrame:
    """Keep rows in which any cell's text holds ``query``, letter case aside."""
    wanted = query.strip().lower()
    cells = [as_text(ref(f.name), f.dataType) for f in df.schema.fields if f.name not in ROW_ORDER and not is_nested(f.dataType)]
    if not wanted or not cells:
        return df
    hits = [F.coalesce(F.lower(cell).contains(wanted), F.lit(False)) for cell in cells]
    return df.filter(reduce(or_, hits))
