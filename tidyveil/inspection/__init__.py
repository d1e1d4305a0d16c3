"""Profiling columns and finding the sensitive ones."""

from tidyveil.inspection.detect import detect_sensitive_columns, name_matches, value_pattern_rates
from tidyveil.inspection.profile import profile_columns
from tidyveil.inspection.protect import auto_protect, protection_steps

__all__ = [
    "auto_protect", "detect_sensitive_columns", "name_matches", "profile_columns", "protection_steps",
    "value_pattern_rates",
]
