"""Statistics of several columns of one table, taken in one pass.

Steps that need a mean, a range, a mode or a median of columns that are as they were in one table ask for them together:
every row gives one short row for each request, and these are put together by request and, for modes and medians, by
value. Means and ranges have no value there, so that each task sends on one row for them. The result is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.functions.columns import need_flat, ref, to_number, without_nan
from tidyveil.operators.ordering import median_of_counts, range_count
from tidyveil.plans.lineage import cut_lineage

#: What can be asked of a column.
KINDS = ("mean", "span", "mode", "median")


def _value_field(dtype: T.DataType) -> str:
    """Values of different types are put together in columns of their own."""
    return f"v_{dtype.simpleString()}"


@dataclass
class Statistics:
    """What was asked of ``base``: pairs of column and kind. Computed when first needed."""

    base: DataFrame
    requests: list[tuple[str, str]]
    _table: DataFrame | None = None

    def __contains__(self, request: tuple[str, str]) -> bool:
        return request in self.requests

    def _rows(self, request: tuple[str, str]) -> DataFrame:
        if self._table is None:
            self._table = cut_lineage(self._gathered())
        return self._table.filter(F.col("request") == self.requests.index(request))

    def _gathered(self) -> DataFrame:
        types = {_value_field(self._type(c, k)): self._type(c, k) for c, k in self.requests if k in ("mode", "median")}

        def one(number: int, column: str, kind: str) -> Column:
            as_number = to_number(ref(column), need_flat(self.base, column)).cast("double")
            value = without_nan(ref(column), need_flat(self.base, column)) if kind == "mode" else as_number
            values = [
                (value if kind in ("mode", "median") and name == _value_field(self._type(column, kind)) else F.lit(None)).cast(t).alias(name) for name, t in types.items()
            ]
            return F.struct(F.lit(number).alias("request"), as_number.alias("number"), *values)

        rows = self.base.select(F.explode(F.array(*[one(i, c, k) for i, (c, k) in enumerate(self.requests)])).alias("x")).select("x.*")
        figures = [F.count(F.lit(1)).alias("n"), F.avg("number").alias("mean"), F.min("number").alias("low"), F.max("number").alias("high")]
        return rows.groupBy("request", *types).agg(*figures)

    def _type(self, column: str, kind: str) -> T.DataType:
        return need_flat(self.base, column) if kind == "mode" else T.DoubleType()

    def mean(self, column: str) -> DataFrame:
        return self._rows((column, "mean")).agg(F.max("mean").alias("fill"))

    def span(self, column: str) -> DataFrame:
        return self._rows((column, "span")).agg(F.min("low").alias("low"), F.max("high").alias("high"))

    def counts(self, column: str, kind: str) -> DataFrame:
        """(v, n): how often the column has each value."""
        value = ref(_value_field(self._type(column, kind)))
        return self._rows((column, kind)).select(value.alias("v"), "n").filter("v IS NOT NULL")

    def median(self, column: str) -> DataFrame:
        return median_of_counts(self.counts(column, "median"), range_count(self.base))
