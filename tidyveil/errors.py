"""Errors raised while a plan is being put together, before any data is read."""


class SanitizeError(Exception):
    """Base class of every error this package raises."""


class StepError(SanitizeError):
    """A step cannot be applied to the table it was given."""


class SpecError(SanitizeError):
    """A saved list of steps is not well formed."""

    def __init__(self, issues: list[str]):
        self.issues = list(issues)
        super().__init__("; ".join(self.issues))


class OutputError(SanitizeError):
    """An output location is unsafe, taken or empty."""
