"""One row per column: type, number of rows, of missing cells and of distinct values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.functions.columns import is_missing, is_temporal, ref, sql_text, without_nan


def kind_of(dtype: T.DataType) -> str:
    if isinstance(dtype, T.NumericType):
        return "Number"
    if is_temporal(dtype):
        return "Date"
    if isinstance(dtype, T.BooleanType):
        return "Yes/No"
    return "Text"


def _countable(dtype: T.DataType) -> bool:
    return not isinstance(dtype, (T.MapType, T.VariantType))


#: Texts up to this length stand for themselves, longer ones by their digest.
_SHORT = 40


def _identity(c: Column, dtype: T.DataType) -> Column:
    """A text that equal values share and different ones don't, of bounded length; NULL for missing ones."""
    value = without_nan(c, dtype)
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = (value + F.lit(0.0)).cast("string")  # there is one zero
    elif isinstance(dtype, T.BinaryType):
        text = F.base64(value)
    elif isinstance(dtype, (T.StructType, T.ArrayType)):
        text = F.when(c.isNotNull(), F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"}))
    elif _countable(dtype):
        text = value.cast("string")
    else:
        return F.when(c.isNotNull(), F.lit(""))
    return F.when(F.length(text) <= _SHORT, F.concat(F.lit("="), text)).otherwise(F.concat(F.lit("#"), F.sha2(text, 256)))


def profile_columns(df: DataFrame, approx: bool = False) -> DataFrame:
    """(position, column, dtype, kind, total, missing, unique); ``unique`` leaves missing cells out.

    Everything comes from one pass. For exact distinct counts every cell becomes a short row of column and value, equal
    ones of which are counted together before they are shuffled; ``approx=True`` keeps a fixed-size sketch per column
    instead. Map columns have no distinct count.
    """
    fields = df.schema.fields
    if not fields:
        return df.sparkSession.createDataFrame(
            [], "position int, column string, dtype string, kind string, total bigint, missing bigint, unique bigint"
        )
    if approx:
        figures = [F.count(F.lit(1)).alias("total")]
        for i, f in enumerate(fields):
            c = ref(f.name)
            figures.append(F.count_if(is_missing(c, f.dataType)).alias(f"missing{i}"))
            unique = F.approx_count_distinct(without_nan(c, f.dataType)) if _countable(f.dataType) else F.max(F.lit(None).cast("bigint"))
            figures.append(unique.alias(f"unique{i}"))
        counted, of = df.agg(*figures), lambda i, figure: figure if figure == "total" else f"{figure}{i}"
    else:
        cells = F.array(*[F.struct(F.lit(i).alias("at"), _identity(ref(f.name), f.dataType).alias("value")) for i, f in enumerate(fields)])
        values = df.select(F.explode(cells).alias("x")).groupBy("x.at", "x.value").agg(F.count(F.lit(1)).alias("n"))
        by_column = values.groupBy("at").agg(
            F.sum("n").alias("total"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("value").alias("unique")
        )
        counted = by_column.agg(F.map_from_entries(F.collect_list(F.struct("at", F.struct("total", "missing", "unique")))).alias("m"))
        of = lambda i, figure: "CAST(NULL AS bigint)" if figure == "unique" and not _countable(fields[i].dataType) else f"coalesce(try_element_at(m, {i}).{figure}, 0L)"
    lines = [
        f"struct({i} AS position, {sql_text(f.name)} AS column, {sql_text(f.dataType.simpleString())} AS dtype, "
        f"'{kind_of(f.dataType)}' AS kind, {of(i, 'total')} AS total, {of(i, 'missing')} AS missing, {of(i, 'unique')} AS unique)"
        for i, f in enumerate(fields)
    ]
    return counted.select(F.expr(f"inline(array({', '.join(lines)}))"))
