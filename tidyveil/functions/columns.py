"""What counts as missing or blank, how a cell reads as text, how a text reads as a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.errors import StepError

# White space in the Unicode sense: as a set to trim, as a class to match, and as a run to squeeze.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SPACE_CLASS = r"\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def ref(name: str) -> Column:
    """The column called exactly ``name``, dots and backticks included."""
    return F.col(sql_name(name))


def sql_name(name: str) -> str:
    """``name`` as it is written in a SQL expression."""
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def type_of(df: DataFrame, name: str) -> T.DataType:
    for field in df.schema.fields:
        if field.name == name:
            return field.dataType
    raise StepError(f"no column named {name!r}")


def has_column(df: DataFrame, name: str) -> bool:
    """Case-sensitive presence test. Raises where Spark could not tell two columns apart."""
    if name not in df.columns:
        return False
    same = [c for c in df.columns if c.lower() == name.lower()]
    if len(same) > 1 and not (
        len(set(same)) == len(same)
        and df.sparkSession.conf.get("spark.sql.caseSensitive", "false") == "true"
    ):
        raise StepError(f"columns {same} are ambiguous; rename one or set spark.sql.caseSensitive=true")
    return True


def replace_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Same columns in the same order, ``name`` computed anew. Check with ``has_column`` first."""
    return df.withColumn(name, value)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.StructType, T.ArrayType, T.MapType, T.BinaryType, T.VariantType))


def is_fractional(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def is_integral(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.IntegralType)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType))


def need_flat(df: DataFrame, name: str) -> T.DataType:
    dtype = type_of(df, name)
    if is_nested(dtype):
        raise StepError(f"column {name!r} is {dtype.simpleString()}; the step takes flat values only")
    return dtype


def is_missing(c: Column, dtype: T.DataType) -> Column:
    return c.isNull() | F.isnan(c) if is_fractional(dtype) else c.isNull()


def without_nan(c: Column, dtype: T.DataType) -> Column:
    return F.nanvl(c, F.lit(None).cast(dtype)) if is_fractional(dtype) else c


def is_blank(c: Column, dtype: T.DataType) -> Column:
    """Missing, or text holding nothing but white space."""
    if isinstance(dtype, T.StringType):
        return c.isNull() | (F.length(strip(c)) == 0)
    return is_missing(c, dtype)


def strip(c: Column) -> Column:
    return F.trim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Inner runs of white space become one space, outer ones go."""
    return F.trim(F.regexp_replace(c, _SPACE_RUN, " "))


def as_text(c: Column, dtype: T.DataType) -> Column:
    """A cell as the text a reader of the data would write: 10000000.0, not 1.0E7."""
    if isinstance(dtype, T.StringType):
        return c
    if isinstance(dtype, T.BooleanType):
        return F.when(c, "True").when(~c, "False")
    if not is_fractional(dtype):
        return c.cast("string")
    # Few expressions on purpose: this is generated code for every cell of every such column.
    shown, size = c.cast("string"), F.abs(c)
    plain = F.regexp_replace(c.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0+$", "$1")
    short = F.regexp_replace(F.lower(shown), r"\.0(?=e)|inity", "")  # 1.0E16 is 1e+16, Infinity inf
    signed = F.regexp_replace(short, r"e(?=\d)", "e+")
    scientific = F.regexp_replace(signed, r"(?<=e[+-])(?=\d$)", "0")
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), shown)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .when(~F.isnan(c), scientific)
    )


def text_column(df: DataFrame, name: str) -> Column:
    return as_text(ref(name), need_flat(df, name))


def text_to_double(c: Column) -> Column:
    """Plain decimal text as a double; anything else NULL (``12d``, ``1_000``, ``nan`` included)."""
    bare = strip(c)
    return F.when(bare.rlike(PLAIN_NUMBER), bare.try_cast("double"))


def to_number(c: Column, dtype: T.DataType) -> Column:
    """The cell as a double, NULL where it is not a number."""
    if isinstance(dtype, T.StringType):
        return text_to_double(c)
    if isinstance(dtype, T.NumericType):
        return without_nan(c.cast("double"), T.DoubleType())
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    return F.lit(None).cast("double")
