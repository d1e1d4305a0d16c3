"""From detections to protected columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidyveil.errors import StepError
from tidyveil.functions.columns import is_temporal, type_of
from tidyveil.inspection.detect import detect_sensitive_columns
from tidyveil.plans.runner import run_steps
from tidyveil.plans.steps import Step

ACTIONS = ("mask", "redact", "hash", "pseudonymize", "generalize", "remove", "skip")
_BY_ACTION = {
    "mask": "MASK_COLUMN",
    "redact": "REDACT_COLUMN",
    "hash": "HASH_COLUMN",
    "pseudonymize": "PSEUDONYMIZE_COLUMN",
    "generalize": "GENERALIZE_COLUMN",
}


def _step(df: DataFrame, column: str, action: str) -> Step | None:
    if action == "skip":
        return None
    if action == "remove":
        return Step("REMOVE_COLUMNS", {"columns": [column]})
    params: dict = {"column": column}
    if action == "generalize" and (
        is_temporal(type_of(df, column)) or not isinstance(type_of(df, column), T.NumericType)
    ):
        params["date_unit"] = "year"
    return Step(_BY_ACTION[action], params)


def protection_steps(df: DataFrame, overrides: dict[str, str] | None = None, **detect_options) -> list[Step]:
    """One privacy step per detected column; ``overrides`` names the action for a column instead.

    Dates (and text taken for dates of birth) are generalized to the year, numbers to ranges.
    """
    chosen = {}
    for column, action in (overrides or {}).items():
        if action not in ACTIONS:
            raise StepError(f"action must be one of {ACTIONS}, not {action!r}")
        if column not in df.columns:
            raise StepError(f"no column named {column!r}")
    # At most one row per column of the table comes back.
    for row in detect_sensitive_columns(df, **detect_options).select("column", "suggested_action").collect():
        chosen[row["column"]] = row["suggested_action"]
    chosen |= overrides or {}
    steps = [_step(df, column, action) for column, action in chosen.items()]
    return [s for s in steps if s is not None]


def auto_protect(df: DataFrame, overrides: dict[str, str] | None = None, **detect_options) -> DataFrame:
    """Detect sensitive columns and protect each as suggested, or as ``overrides`` says.

    Detection runs as one aggregate when this is called; the protected table itself is lazy.
    """
    return run_steps(df, protection_steps(df, overrides, **detect_options)).data
