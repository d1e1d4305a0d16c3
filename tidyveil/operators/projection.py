"""Choosing, dropping, renaming and ordering columns. Names are matched exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.errors import StepError
from tidyveil.functions.columns import has_column, is_missing, ref


def select_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep the known names in the order given; if none is known, keep everything."""
    known = [c for c in columns if has_column(df, c)]
    return df.select(*map(ref, known)) if known else df


def remove_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    gone = {c for c in columns if has_column(df, c)}
    return df.select(*[ref(c) for c in df.columns if c not in gone]) if gone else df


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """All renames happen at once, so names can be swapped."""
    names = [mapping.get(c, c) for c in df.columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise StepError(f"renaming would give several columns the name {twice}")
    return df.toDF(*names)


def reorder_columns(df: DataFrame, order: list[str]) -> DataFrame:
    """The listed columns first, the others after them as they stood."""
    first = [c for c in dict.fromkeys(order) if has_column(df, c)]
    return df.select(*[ref(c) for c in first + [c for c in df.columns if c not in first]])


def drop_placeholder_columns(df: DataFrame) -> DataFrame:
    """Drop ``Unnamed…`` columns and those with no value at all. Runs one aggregate over the table."""
    named = [c for c in df.columns if not c.startswith("Unnamed")]
    if not named:
        return df.select()
    fields = {f.name: f.dataType for f in df.schema.fields}
    filled = df.agg(
        *[F.count_if(~is_missing(ref(c), fields[c])).alias(f"n{i}") for i, c in enumerate(named)]
    ).first()
    return df.select(*[ref(c) for i, c in enumerate(named) if filled[i]])
