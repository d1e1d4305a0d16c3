"""Statistical privacy: ranges, bands, and suppression of small groups."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.constants import BAND_EDGES, BAND_LABELS, SUPPRESSED
from tidyveil.errors import StepError
from tidyveil.functions.columns import (
    as_text,
    has_column,
    is_missing,
    need_flat,
    ref,
    replace_column,
    to_number,
)
from tidyveil.functions.parsing import with_moment
from tidyveil.operators.lookup import BROADCAST_ROWS, HOT_SHARE, attach_by_value

if TYPE_CHECKING:
    from tidyveil.plans.statistics import Statistics

_DATE_UNITS = {"month": "yyyy-MM", "year": "yyyy"}


def _edge_text(edge: float) -> str:
    return repr(float(edge)) if isinstance(edge, float) else str(edge)


def _interval_labels(edges: list[float]) -> list[str]:
    pairs = list(zip(edges, edges[1:]))
    return [f"{'[' if i == 0 else '('}{_edge_text(a)}, {_edge_text(b)}]" for i, (a, b) in enumerate(pairs)]


def _between_edges(number: Column, edges: list[float], labels: list[str]) -> Column:
    """Right-closed intervals, the lowest edge included; NULL outside."""
    label = F.when(number < F.lit(float(edges[0])), F.lit(None).cast("string"))
    for upper, text in zip(edges[1:], labels):
        label = label.when(number <= F.lit(float(upper)), F.lit(text))
    return label


def _equal_width(span: DataFrame, bins: int, labels: list[str] | None) -> DataFrame:
    """One row: a struct of the inner edges (as doubles) and the ``bins`` labels. ``span`` has the least and greatest number."""
    low, high = F.col("low"), F.col("high")
    # A single value gets a span around it, as wide as a thousandth of its size.
    pad = F.when(low == high, F.when(low == 0, F.lit(0.001)).otherwise(F.abs(low) * 0.001)).otherwise(0.0)
    span = span.select(
        (low - pad).alias("low"), (high + pad).alias("high")
    )
    width = (high - low) / bins
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(bins)),
        lambda i: F.when(i == bins, high).otherwise(low + i * width),
    )
    if labels is None:
        shown = F.transform(
            F.col("edges"),
            lambda e: as_text(F.when(F.col("width") >= 0.01, F.round(e, 3)).otherwise(e), T.DoubleType()),
        )
        texts = F.transform(
            F.sequence(F.lit(0), F.lit(bins - 1)),
            lambda i: F.concat(
                F.when(i == 0, "[").otherwise("("), F.get(F.col("shown"), i), F.lit(", "), F.get(F.col("shown"), i + 1), F.lit("]")
            ),
        )
    else:
        shown, texts = F.lit(None), F.array(*[F.lit(t) for t in labels])
    return (
        span.select(edges.alias("edges"), width.alias("width"))
        .select("edges", shown.alias("shown"))
        .select(F.struct("edges", texts.alias("labels")).alias("cut"))
    )


def generalize_column(
    df: DataFrame,
    column: str,
    bins: int | list[float] = 5,
    labels: list[str] | None = None,
    round_to: float | None = None,
    date_unit: str | None = None,
    stats_from: DataFrame | Statistics | None = None,
) -> DataFrame:
    """Put values into ranges, shown as text.

    ``bins`` is a number of equal-width ranges between the column's least and greatest number, or
    the list of edges. Ranges include their upper edge, the first one also its lower edge; numbers
    outside given edges, and cells that are no numbers, become NULL. ``labels`` replace the range
    texts. ``round_to`` gives the nearest multiple instead (halves away from zero), ``date_unit``
    (``"month"`` or ``"year"``) the month or year of a date.
    """
    if not has_column(df, column):
        return df
    c, dtype = ref(column), need_flat(df, column)
    if date_unit is not None:
        if date_unit not in _DATE_UNITS:
            raise StepError(f"date_unit must be month or year, not {date_unit!r}")
        return replace_column(with_moment(df, column), column, F.date_format(c, _DATE_UNITS[date_unit]))
    number = to_number(c, dtype)
    if round_to is not None:
        if not float(round_to) > 0:
            raise StepError(f"round_to must be positive, not {round_to!r}")
        whole = float(round_to).is_integer()
        nearest = F.round(number / F.lit(float(round_to))) * F.lit(float(round_to))
        return replace_column(df, column, nearest.cast("bigint") if whole else nearest)
    if isinstance(bins, bool) or not isinstance(bins, (int, list, tuple)):
        raise StepError(f"bins must be a count or a list of edges, not {bins!r}")
    count = bins if isinstance(bins, int) else len(bins) - 1
    if count < 1:
        raise StepError("bins must give at least one range")
    if labels is not None and len(labels) != count:
        raise StepError(f"{count} ranges need {count} labels, got {len(labels)}")
    if not isinstance(bins, int):
        edges = list(bins)
        if any(b <= a for a, b in zip(edges, edges[1:])):
            raise StepError("bin edges must increase")
        return replace_column(df, column, _between_edges(number, edges, labels or _interval_labels(edges)))
    base = df if stats_from is None else stats_from
    if isinstance(base, DataFrame):
        span = base.agg(F.min(number).alias("low"), F.max(number).alias("high"))
    else:
        span = base.span(column)
    cut = _equal_width(span, bins, labels).scalar()
    edges = cut.getField("edges")
    below = F.lit(0)
    for i in range(1, bins):
        below = below + F.when(number > F.get(edges, F.lit(i)), 1).otherwise(0)
    return replace_column(df, column, F.when(number.isNotNull(), F.get(cut.getField("labels"), below)))


def revenue_bands(df: DataFrame, column: str) -> DataFrame:
    """Six fixed bands of money, upper edges included; what is no number becomes NULL."""
    if not has_column(df, column):
        return df
    number = to_number(ref(column), need_flat(df, column))
    band = F.when(number.isNull(), F.lit(None).cast("string"))
    for upper, text in zip(BAND_EDGES, BAND_LABELS):
        band = band.when(number <= F.lit(float(upper)), F.lit(text))
    return replace_column(df, column, band.otherwise(F.lit(BAND_LABELS[-1])))


def suppress_low_counts(
    df: DataFrame,
    group_column: str,
    threshold: int = 5,
    replacement: str = SUPPRESSED,
    stats_from: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Replace values held by fewer than ``threshold`` rows; missing cells stay missing.

    One count per value runs at once; only the rare values are then looked up.
    """
    if not has_column(df, group_column):
        return df
    c, dtype = ref(group_column), need_flat(df, group_column)
    base = df if stats_from is None else stats_from
    counts = (
        base.select(as_text(c, dtype).alias("key"))
        .filter("key is not null")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    # Hot values come along, unmarked, so that the lookup knows which rows not to shuffle on.
    is_rare = F.col("copies") < threshold
    is_hot = F.col("copies") >= counts.agg(F.sum("copies")).scalar() * HOT_SHARE
    marks = counts.filter(is_rare | is_hot).withColumn("payload", F.when(is_rare, F.lit(replacement)))
    keyed = df.withColumn("__text", as_text(c, dtype))
    marked = attach_by_value(keyed, "__text", marks, broadcast_rows)
    if isinstance(dtype, T.StringType):
        kept = ref(group_column)
    else:
        kept = F.col("__text")
    value = F.when(~is_missing(ref(group_column), dtype), F.coalesce("__payload", kept))
    return replace_column(marked, group_column, value).select(*map(ref, df.columns))
