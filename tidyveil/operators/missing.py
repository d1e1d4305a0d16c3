"""Filling or dropping missing values."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal, InvalidOperation
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.errors import StepError
from tidyveil.functions.columns import (
    as_text,
    has_column,
    is_integral,
    is_missing,
    is_temporal,
    need_flat,
    ref,
    replace_column,
    to_number,
    without_nan,
)
from tidyveil.operators.ordering import carry_fill, exact_median

if TYPE_CHECKING:
    from tidyveil.plans.statistics import Statistics


def _literal(value: Any, dtype: T.DataType) -> Column | None:
    """``value`` in the column's type, or None where the column must turn into text to hold it."""
    if isinstance(dtype, T.StringType):
        return F.lit(str(value))
    if isinstance(dtype, T.BooleanType):
        return F.lit(value) if isinstance(value, bool) else None
    if isinstance(dtype, T.NumericType) and not isinstance(value, bool):
        try:
            number = Decimal(str(value).strip())
        except InvalidOperation:
            return None
        if not number.is_finite():
            return None
        if is_integral(dtype) and number == number.to_integral_value():
            return F.lit(int(number)).cast(dtype)
        return F.lit(float(number)) if not isinstance(dtype, T.DecimalType) else F.lit(number)
    if is_temporal(dtype):
        try:
            return F.lit(datetime.fromisoformat(str(value)).isoformat(" ")).cast(dtype)
        except ValueError:
            return None
    return None


def fill_missing(
    df: DataFrame,
    column: str,
    strategy: str = "value",
    value: Any = None,
    order_by: list[str] | None = None,
    partition_by: list[str] | None = None,
    approx: bool = False,
    stats_from: DataFrame | Statistics | None = None,
) -> DataFrame:
    """Fill (or drop) the missing cells of one column; blank text is not missing.

    ``value`` puts in ``value`` (default: empty text); ``mean`` and ``median`` use the cells that are
    numbers; ``mode`` the most frequent cell, the smallest of equals; ``forward`` and ``backward``
    the nearest earlier / later cell in ``order_by``; ``drop`` removes the rows. ``approx=True`` takes
    a sketch for the median. ``stats_from`` is a table with the same values in this column that is
    cheaper to scan, or the statistics of one that were taken together. ``mean`` and ``mode`` are scalar subqueries of the result; the exact ``median``
    counts the column's values, and ``forward`` / ``backward`` sample the order, when called.
    An unknown strategy changes nothing.
    """
    if not has_column(df, column):
        return df
    c, dtype = ref(column), need_flat(df, column)
    kept = without_nan(c, dtype)
    base = df if stats_from is None else stats_from

    if strategy == "drop":
        return df.filter(~is_missing(c, dtype))
    if strategy == "value":
        fill = _literal("" if value is None else value, dtype)
        if fill is None:
            return replace_column(df, column, F.coalesce(as_text(c, dtype), F.lit(str("" if value is None else value))))
        return replace_column(df, column, F.coalesce(kept, fill))
    if strategy in ("mean", "median"):
        number = to_number(c, dtype)
        if not isinstance(base, DataFrame):
            stat = base.mean(column) if strategy == "mean" else base.median(column)
        elif strategy == "mean":
            stat = base.agg(F.avg(number).alias("fill"))
        elif approx:
            stat = base.agg(F.percentile_approx(number, 0.5, 10_000).alias("fill"))
        else:
            stat = exact_median(base, number)
        if isinstance(dtype, T.NumericType):
            return replace_column(df, column, F.coalesce(kept.cast("double"), stat.scalar()))
        text = stat.select(as_text(F.col(stat.columns[0]), T.DoubleType()).alias("fill"))
        return replace_column(df, column, F.coalesce(as_text(c, dtype), text.scalar()))
    if strategy == "mode":
        if isinstance(base, DataFrame):
            counts = base.select(kept.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        else:
            counts = base.counts(column, "mode")
        top = counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v"))).alias("fill"))
        fill = top.scalar()
        if isinstance(dtype, T.StringType):
            fill = F.coalesce(fill, F.lit(""))
        return replace_column(df, column, F.coalesce(kept, fill))
    if strategy in ("forward", "backward"):
        if not order_by:
            raise StepError(f"{strategy} fill needs order_by: Spark tables have no row order of their own")
        for name in [*order_by, *(partition_by or [])]:
            if not has_column(df, name):
                raise StepError(f"no column named {name!r}")
        return carry_fill(df, column, kept, order_by, partition_by, backward=strategy == "backward")
    return df


