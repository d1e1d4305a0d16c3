"""Which steps can run on a stream: those whose output row depends on one input row alone."""

from __future__ import annotations

from tidyveil.errors import StepError
from tidyveil.plans.steps import Step, is_row_local, title_of


def batch_only_steps(steps: list[Step]) -> list[Step]:
    return [s for s in steps if s.enabled and not is_row_local(s)]


def check_streamable(steps: list[Step]) -> None:
    """Raise unless every enabled step works row by row."""
    refused = batch_only_steps(steps)
    if refused:
        names = ", ".join(title_of(s) for s in refused)
        raise StepError(f"these steps need the whole table and cannot run on a stream: {names}")
