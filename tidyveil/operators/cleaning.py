"""White space, empty rows and columns, duplicates."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.constants import ROW_ORDER
from tidyveil.errors import StepError
from tidyveil.functions.columns import has_column, is_blank, ref, squeeze, without_nan


def trim_whitespace(df: DataFrame) -> DataFrame:
    """Strip text cells and headers; inner runs of white space become one space."""
    headers = [c.strip() for c in df.columns]
    twice = sorted({h for h in headers if headers.count(h) > 1})
    if twice:
        raise StepError(f"stripping headers would give several columns the name {twice}")
    return df.select(
        *[
            (squeeze(ref(f.name)) if isinstance(f.dataType, T.StringType) else ref(f.name)).alias(header)
            for f, header in zip(df.schema.fields, headers)
        ]
    )


def remove_empty_rows(df: DataFrame) -> DataFrame:
    """Drop rows in which every cell is missing or blank."""
    cells = [is_blank(ref(f.name), f.dataType) for f in df.schema.fields if f.name not in ROW_ORDER]
    return df.filter(~reduce(and_, cells)) if cells else df


def remove_empty_columns(df: DataFrame) -> DataFrame:
    """Drop columns in which every cell is missing or blank.

    The schema depends on the data here, so this runs one aggregate over the table (one result row).
    """
    if not df.columns:
        return df
    filled = df.agg(
        *[F.count_if(~is_blank(ref(f.name), f.dataType)).alias(f"n{i}") for i, f in enumerate(df.schema.fields)]
    ).first()
    return df.select(*[ref(c) for c, n in zip(df.columns, filled) if n])


def _orderable(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.StructType):
        return all(_orderable(f.dataType) for f in dtype.fields)
    if isinstance(dtype, T.ArrayType):
        return _orderable(dtype.elementType)
    return not isinstance(dtype, (T.MapType, T.VariantType))


def remove_duplicates(
    df: DataFrame,
    subset: list[str] | None = None,
    keep: str | bool = "first",
    order_by: list[str] | None = None,
) -> DataFrame:
    """One row per distinct ``subset`` (default: all columns but ``ROW_ORDER``); missing values are equal to each other.

    ``keep`` is ``"first"`` or ``"last"`` in ``order_by``, or ``False`` to drop every row that has a
    double. Rows alike in ``order_by`` are told apart by their other columns, so the outcome does
    not depend on partitioning. Grouping is combined before the shuffle: however many rows share a
    key, each task sends on at most one of them.
    """
    if keep not in ("first", "last", False):
        raise StepError(f"keep must be 'first', 'last' or False, not {keep!r}")
    keys = [c for c in df.columns if c not in ROW_ORDER] if subset is None else list(subset)
    for name in [*keys, *(order_by or [])]:
        if not has_column(df, name):
            raise StepError(f"no column named {name!r}")
    whole_row = set(keys) == set(df.columns)
    types = {f.name: f.dataType for f in df.schema.fields}
    clean = df.select(*[without_nan(ref(c), types[c]).alias(c) for c in df.columns])

    if whole_row and keep is not False:
        return clean.dropDuplicates()
    if whole_row:
        counted = clean.groupBy(*map(ref, keys)).agg(F.count(F.lit(1)).alias("__copies"))
        return counted.filter(F.col("__copies") == 1).drop("__copies")

    rest = [c for c in df.columns if c not in keys]
    ordered = [c for c in (order_by or []) if c not in keys] + [c for c in rest if c not in (order_by or [])]
    ordered = [c for c in ordered if _orderable(types[c])]
    loose = [c for c in rest if c not in ordered]
    rank = F.struct(*[ref(c).alias(f"r{i}") for i, c in enumerate(ordered)]) if ordered else F.lit(0)
    grouped = clean.groupBy(*map(ref, keys))
    extra = [F.count(F.lit(1)).alias("__copies")] if keep is False else []
    pick_one, pick_by = (F.max, F.max_by) if keep == "last" else (F.min, F.min_by)
    if loose:
        row = F.struct(rank.alias("rank"), F.struct(*map(ref, loose)).alias("loose"))
        picked = grouped.agg(pick_by(row, rank).alias("__row"), *extra)
    else:
        picked = grouped.agg(pick_one(F.struct(rank.alias("rank"))).alias("__row"), *extra)
    if keep is False:
        picked = picked.filter(F.col("__copies") == 1)
    where = {c: F.col("__row.rank").getField(f"r{i}") for i, c in enumerate(ordered)}
    where |= {c: F.col("__row.loose").getField(c) for c in loose}
    return picked.select(*[where[c].alias(c) if c in where else ref(c) for c in df.columns])
