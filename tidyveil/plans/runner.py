"""Running a list of steps: they fold into one DataFrame that Spark plans as a whole."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from tidyveil.constants import ROW_ORDER
from tidyveil.errors import StepError
from tidyveil.functions.columns import has_column, need_flat
from tidyveil.plans.lineage import cut_lineage
from tidyveil.plans.statistics import Statistics
from tidyveil.plans.steps import (
    Step,
    accepts,
    bound_params,
    changes_rows,
    is_row_local,
    kind_of_step,
    load_steps,
    protects,
    statistic_of,
    title_of,
)
from tidyveil.streaming.guard import check_streamable

MAX_SCANS = 16
_FILL_SCANS = 3  # bounds, their row count, and the tail of each range

METRICS_SCHEMA = (
    "step int, step_name string, rows_before bigint, rows_after bigint, cols_before int, cols_after int, "
    "success boolean, error string"
)


@dataclass
class StepOutcome:
    """What is known of a step while the plan is put together."""

    name: str
    cols_before: int
    cols_after: int
    success: bool
    error: str | None
    stage: int  # index into StepsResult.stages: the rows after this step
    stage_before: int


@dataclass
class StepsResult:
    """The planned table, and the way to its figures."""

    data: DataFrame
    outcomes: list[StepOutcome]
    stages: list[DataFrame] = field(repr=False)
    cols_before: int = 0

    @property
    def success(self) -> bool:
        return all(o.success for o in self.outcomes)

    def row_counts(self) -> DataFrame:
        """(stage, rows): one count per set of rows the steps went through, read column-pruned.

        Separate counts rather than figures observed on the way: those are counted again when a
        lost executor makes Spark run a stage twice, and an audit figure must not be.
        """
        counts = [s.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(i).alias("stage"), "rows") for i, s in enumerate(self.stages)]
        result = counts[0]
        for c in counts[1:]:
            result = result.unionByName(c)
        return result

    def metrics(self) -> DataFrame:
        """One row per step that was tried: rows and columns before and after, success, error."""
        spark = self.data.sparkSession
        if not self.outcomes:
            return spark.createDataFrame([], METRICS_SCHEMA)
        sizes = {i: self.stages[i].agg(F.count(F.lit(1)).alias("n")).scalar() for i in range(len(self.stages))}
        lines = [
            F.struct(
                F.lit(number).cast("int").alias("step"),
                F.lit(o.name).alias("step_name"),
                sizes[o.stage_before].alias("rows_before"),
                sizes[o.stage].alias("rows_after"),
                F.lit(o.cols_before).cast("int").alias("cols_before"),
                F.lit(o.cols_after).cast("int").alias("cols_after"),
                F.lit(o.success).alias("success"),
                F.lit(o.error).cast("string").alias("error"),
            )
            for number, o in enumerate(self.outcomes, start=1)
        ]
        return spark.range(1).select(F.inline(F.array(*lines)))

    def summary_text(self, total_seconds: float | None = None) -> str:
        """The figures as text. Counts the rows of each stage once."""
        rows = {r["stage"]: r["rows"] for r in self.row_counts().collect()}  # one short row per stage
        lines = []
        for number, o in enumerate(self.outcomes, start=1):
            line = f"{'ok' if o.success else 'FAILED'} {number}. {o.name}"
            more_rows = rows[o.stage] - rows[o.stage_before]
            if more_rows:
                line += f", rows {more_rows:+d}"
            if o.cols_after != o.cols_before:
                line += f", columns {o.cols_after - o.cols_before:+d}"
            if o.error:
                line += f", error: {o.error}"
            lines.append(line)
        lines.append(f"rows {rows[0]} -> {rows[len(self.stages) - 1]}")
        lines.append(f"columns {self.cols_before} -> {_width(self.data)}")
        if total_seconds is not None:
            lines.append(f"total {total_seconds:.3f} s")
        return "\n".join(lines)


def _width(df: DataFrame) -> int:
    return sum(c not in ROW_ORDER for c in df.columns)


def _check_columns(df: DataFrame, step: Step, params: dict[str, Any], require_columns: bool) -> None:
    kind = kind_of_step(step)
    name = params.get(kind.column_param)
    if kind.protects and require_columns and isinstance(name, str) and not has_column(df, name):
        raise StepError(f"{title_of(step)}: no column named {name!r}, so nothing would be protected")


def _request(step: Step, df: DataFrame) -> tuple[str, str] | None:
    """The statistic a step wants, as column and kind, if ``df`` has it to give."""
    column, kind = step.params.get("column"), statistic_of(step)
    if kind is None or not isinstance(column, str) or not has_column(df, column):
        return None
    try:
        need_flat(df, column)
    except StepError:
        return None
    return column, kind


def _gathered(steps: list[Step], base: DataFrame, changed: set[str]) -> Statistics:
    """What ``steps`` want of columns as they are in ``base``, up to the first that changes more than a column."""
    requests, changed = [], set(changed)
    for step in steps:
        try:
            kind, params = kind_of_step(step), bound_params(step)
        except StepError:
            continue  # told when its turn comes
        request = _request(step, base)
        if request and request[0] not in changed and request not in requests:
            requests.append(request)
        if changes_rows(step) or kind.changes != "column":
            break
        changed.add(params.get(kind.column_param))
    return Statistics(base, requests)


def _apply(df: DataFrame, step: Step, order_by: list[str] | None, require_columns: bool, stats_from: DataFrame | Statistics) -> DataFrame:
    params = bound_params(step)
    _check_columns(df, step, params, require_columns)
    if accepts(step, "stats_from"):
        params["stats_from"] = stats_from
    if order_by and accepts(step, "order_by") and params.get("order_by") is None:
        if gone := [c for c in order_by if not has_column(df, c)]:
            raise StepError(f"{title_of(step)}: no column to order by named {gone}")
        params["order_by"] = list(order_by)
    result = kind_of_step(step).function(df, **params)
    result.schema  # resolve now, so that an error is this step's
    return result


def run_steps(
    df: DataFrame,
    steps: str | dict[str, Any] | list[Step],
    on_error: str = "fail",
    require_columns: bool = True,
    order_by: list[str] | None = None,
) -> StepsResult:
    """Apply the enabled steps in order; ``.data`` of the result is the planned table.

    ``on_error="fail"`` stops at a step that cannot be applied; ``"skip"`` records it and goes on
    without it, unless the step is there to protect values: going on would publish them. With ``require_columns`` a privacy step whose column is absent is such an error,
    where otherwise it would quietly protect nothing. ``order_by`` is the row order for steps that
    need one and name none; each has to be there when such a step comes.

    Column statistics are read from the last table that still has the same values in that column. What
    several steps want of one table is gathered in a single pass over it and stored. Fills that follow
    the order of rows read what is before them several times each: if the plan would scan its source
    more than MAX_SCANS times, the table is stored first and the plan goes on from there.
    """
    if on_error not in ("fail", "skip"):
        raise StepError(f"on_error must be 'fail' or 'skip', not {on_error!r}")
    todo = [s for s in load_steps(steps) if s.enabled]
    if df.isStreaming:
        check_streamable(todo)
    current, scans = df, 1
    unchanged_since: dict[str, tuple[DataFrame, int]] = {}
    base = (df, 1)
    gathered: Statistics | None = None
    stages, outcomes = [df], []
    for turn, step in enumerate(todo):
        before, stage_before = current, len(stages) - 1
        try:
            kind = kind_of_step(step)
            params = bound_params(step)
            column = params.get(kind.column_param)
            extra = 0
            stats_from, stats_scans = unchanged_since.get(column, base)
            request = _request(step, base[0])
            if request and column not in unchanged_since and (gathered is None or gathered.base is not base[0]):
                gathered = _gathered(todo[turn:], base[0], set(unchanged_since))
            together = request and column not in unchanged_since and request in gathered and len(gathered.requests) > 1
            if not together and not is_row_local(step) and kind.reads:
                ordered = params.get("strategy") in ("forward", "backward")
                extra = scans * _FILL_SCANS if ordered else stats_scans * kind.reads
            if scans + extra > MAX_SCANS:
                current, scans = cut_lineage(current), 1
                unchanged_since, base = {}, (current, 1)
                stats_from, extra = current, _FILL_SCANS
            current = _apply(current, step, order_by, require_columns, gathered if together else stats_from)
            scans += extra
        except (StepError, AnalysisException, TypeError, ValueError) as exc:
            if on_error == "fail" or protects(step):
                raise
            outcomes.append(
                StepOutcome(title_of(step), _width(before), _width(before), False, str(exc), stage_before, stage_before)
            )
            continue
        if changes_rows(step):
            stages.append(current)
        if changes_rows(step) or kind.changes != "column":
            unchanged_since, base = {}, (current, scans)
        else:
            unchanged_since[column] = (current, scans)
        outcomes.append(
            StepOutcome(title_of(step), _width(before), _width(current), True, None, len(stages) - 1, stage_before)
        )
    return StepsResult(current, outcomes, stages, _width(df))
