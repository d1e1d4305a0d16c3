"""Order-dependent work without one global window.

A window with no partition key runs in a single task. Here rows are first dealt into ranges of the
order key, each holding about the same share of the rows; a window then runs inside each range, and
one small table with a row per range carries state from range to range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.errors import StepError
from tidyveil.functions.columns import need_flat, ref, replace_column
from tidyveil.plans.lineage import cut_lineage

MIN_RANGES = 16
SAMPLES_PER_RANGE = 32
_SEED = 20_011

RANGE = "__range"
KEY = "__key"
TIE = "__tie"


def range_count(df: DataFrame) -> int:
    """Ranges follow the session's shuffle width, which is what sizes every other task."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_RANGES, width)


def _sortable(c: Column, dtype: T.DataType) -> Column:
    """The value in a type that keeps its order and passes through JSON unharmed."""
    if isinstance(dtype, T.IntegralType):
        return c.cast("bigint")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return c.cast("double")
    if isinstance(dtype, (T.StringType, T.BooleanType, T.DecimalType)):
        return c
    if isinstance(dtype, T.DateType):
        return F.unix_date(c)
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(dtype, T.TimestampNTZType):  # by its parts, as no time zone may come into it
        of_day = F.hour(c) * 3600 + F.minute(c) * 60
        second = (F.date_part(F.lit("SECOND"), c) * 1_000_000).cast("bigint")
        return (F.unix_date(c.cast("date")).cast("bigint") * 86_400 + of_day) * 1_000_000 + second
    raise StepError(f"rows cannot be ordered by {dtype.simpleString()}")


def order_key(df: DataFrame, columns: list[str], tie: list[str]) -> Column:
    """``columns`` as one comparable value. Rows alike in them are told apart by a hash of ``tie``,
    so their order is the same on every run, and many of them still spread over several ranges."""
    parts = [_sortable(ref(c), need_flat(df, c)).alias(f"k{i}") for i, c in enumerate(columns)]
    return F.struct(*parts, F.xxhash64(*map(ref, tie)).alias("tie"))


def _bounds_json(keyed: DataFrame, ranges: int, rows: int | None) -> str:
    """``ranges - 1`` ascending keys that cut the rows into about equal shares, as JSON.

    They come from a sample of SAMPLES_PER_RANGE keys a range, whatever the size of the table. It
    only places the cuts: every row is then dealt into a range.
    """
    keys = keyed.select(KEY)
    rows = keys.count() if rows is None else rows
    wanted = ranges * SAMPLES_PER_RANGE
    sample = keys if rows <= wanted else keys.sample(False, wanted / rows, _SEED)
    seen = sample.agg(F.sort_array(F.collect_list(KEY)).alias("seen"))
    cuts = F.transform(
        F.sequence(F.lit(1), F.lit(ranges - 1)),
        lambda i: F.get(F.col("seen"), F.floor(i * F.size("seen") / ranges).cast("int")),
    )
    return seen.select(F.to_json(F.filter(cuts, lambda k: k.isNotNull()))).first()[0]


def with_range(keyed: DataFrame, ranges: int, rows: int | None = None) -> DataFrame:
    """Add ``__range``: how many of the range bounds lie below the row's ``__key``.

    Runs one count, unless ``rows`` tells it, and one sample of the keys. The bounds become one constant of the plan, and the
    binary search over them a projection per halving, so the whole search is generated code.
    """
    bounds = F.from_json(F.lit(_bounds_json(keyed, ranges, rows)), T.ArrayType(keyed.schema[KEY].dataType))
    searched = keyed.withColumn(RANGE, F.lit(0))
    jump = 1 << ((ranges - 1).bit_length() - 1)
    while jump:
        ahead = F.col(KEY) > F.get(bounds, F.col(RANGE) + F.lit(jump - 1))
        searched = searched.withColumn(RANGE, F.col(RANGE) + F.when(ahead, jump).otherwise(0))
        jump //= 2
    return searched


def carry_fill(
    df: DataFrame,
    column: str,
    value: Column,
    order_by: list[str],
    partition_by: list[str] | None = None,
    backward: bool = False,
) -> DataFrame:
    """``column`` with each missing ``value`` taken from the nearest earlier (later) one.

    With ``partition_by`` the value must come from the same group. Ranges are cut over group and
    order key together, so one very large group is spread over many tasks like any other rows.
    The two small passes (bounds, tail of each range) read the columns named here and no other.
    """
    groups = list(partition_by or [])
    plain = replace_column(df, column, value)
    key = order_key(plain, [*groups, *order_by], [column])
    keyed = with_range(plain.select("*", key.alias(KEY)), range_count(df))

    group = F.struct(*[ref(c).alias(f"g{i}") for i, c in enumerate(groups)], F.lit(0).alias("all"))
    present = ref(column).isNotNull()
    latest, enter, leave = (F.min_by, F.max_by, F.min_by) if backward else (F.max_by, F.min_by, F.max_by)
    tail = (
        keyed.groupBy(RANGE)
        .agg(
            enter(group, KEY).alias("enter"),
            leave(group, KEY).alias("leave"),
            latest(F.when(present, F.struct(group.alias("g"), ref(column).alias("v"))), F.when(present, F.col(KEY))).alias("held"),
        )
        .select(RANGE, "enter", "leave", F.when(F.col("held.g") == F.col("leave"), F.col("held.v")).alias("v"))
    )
    # At most one row per range from here on: a bounded table.
    step = F.col(RANGE).desc() if backward else F.col(RANGE).asc()
    so_far = W.partitionBy("leave").orderBy(step).rowsBetween(W.unboundedPreceding, W.currentRow)
    carried = (
        tail.select(RANGE, "enter", "leave", F.last("v", ignorenulls=True).over(so_far).alias("v"))
        .select(RANGE, "enter", F.lag(F.struct("leave", "v")).over(W.orderBy(step)).alias("before"))
        .filter(F.col("before.leave") == F.col("enter"))
        .select(F.col(RANGE).alias("__to"), F.col("enter").alias("__enter"), F.col("before.v").alias("__carried"))
    )
    # The key itself is not shuffled: its columns are in the row anyway, its last part is kept.
    slim = keyed.select(*map(ref, df.columns), F.col(KEY)["tie"].alias(TIE), RANGE)
    turn = [ref(c).desc_nulls_last() if backward else ref(c).asc_nulls_first() for c in [*order_by, TIE]]
    inner = (
        W.partitionBy(RANGE, *map(ref, groups)).orderBy(*turn).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    filled = slim.withColumn("__near", F.last(ref(column), ignorenulls=True).over(inner)).join(
        F.broadcast(carried), F.col(RANGE) == F.col("__to"), "left"
    )
    carry = F.when(group == F.col("__enter"), F.col("__carried"))
    return replace_column(filled, column, F.coalesce("__near", carry)).select(*map(ref, df.columns))


def row_numbers_between(df: DataFrame, order_by: list[str], first: int, last: int, rows: int | None = None) -> DataFrame:
    """The rows numbered ``first … last`` (from 1) in ``order_by``, with column ``__row_number``.

    Only the ranges the wanted numbers fall into are sorted. ``rows`` is their number, if that is known.
    """
    keyed = with_range(df.select("*", order_key(df, order_by, df.columns).alias(KEY)), range_count(df), rows)
    sizes = keyed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1))
    wanted = (
        sizes.select(F.col(RANGE).alias("__at"), "size", F.coalesce(before, F.lit(0)).alias("__before"))
        .filter((F.col("__before") < last) & (F.col("__before") + F.col("size") >= first))
        .drop("size")
    )
    number = F.row_number().over(W.partitionBy(RANGE).orderBy(KEY)) + F.col("__before")
    return (
        keyed.join(F.broadcast(wanted), F.col(RANGE) == F.col("__at"))
        .withColumn("__row_number", number)
        .filter(F.col("__row_number").between(first, last))
        .select(*map(ref, df.columns), "__row_number")
    )


def exact_median(df: DataFrame, value: Column) -> DataFrame:
    """One row, one column ``median``: the middle of the non-null values (mean of the middle two).

    Equal values are counted together once, and the counts stored. Only the range or two of them
    holding the middle is sorted, so no task sees more than its share of the distinct values.
    """
    counts = cut_lineage(
        df.select(value.alias("v")).filter("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    )
    return median_of_counts(counts, range_count(df))


def median_of_counts(counts: DataFrame, ranges: int) -> DataFrame:
    """The median of values ``v`` of which there are ``n`` each. ``counts`` should be stored, as it is read several times."""
    keyed = with_range(counts.select("v", "n", F.struct("v").alias(KEY)), ranges)
    sizes = keyed.groupBy(RANGE).agg(F.sum("n").alias("size"))
    upto = W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = (
        sizes.select(
            F.col(RANGE).alias("__at"),
            "size",
            F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before"),
            F.sum("size").over(W.orderBy(RANGE).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("total"),
        )
        .filter((F.col("before") <= high) & (F.col("before") + F.col("size") > low))
        .drop("size")
    )
    running = W.partitionBy(RANGE).orderBy("v").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = F.col("before") + F.sum("n").over(running)
    placed = keyed.join(F.broadcast(middle), F.col(RANGE) == F.col("__at")).select(
        "v", (last - F.col("n")).alias("start"), last.alias("stop"), low.alias("low"), high.alias("high")
    )

    def at(position: str) -> Column:
        return F.min(F.when((F.col("start") <= F.col(position)) & (F.col(position) < F.col("stop")), F.col("v")))

    return placed.agg(((at("low") + at("high")) / 2).alias("median"))
