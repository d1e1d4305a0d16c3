"""Cleaning, normalizing and de-identifying tables on Spark."""

from tidyveil.inspection import auto_protect, detect_sensitive_columns, profile_columns
from tidyveil.operators import *  # noqa: F401,F403
from tidyveil.plans.runner import StepsResult, run_steps
from tidyveil.plans.steps import Step, dump_steps, load_steps, spec_issues

__all__ = [
    "Step", "StepsResult", "auto_protect", "detect_sensitive_columns", "dump_steps", "load_steps",
    "profile_columns", "run_steps", "spec_issues",
]
