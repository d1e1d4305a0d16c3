"""Steps on a streaming DataFrame."""

from tidyveil.streaming.guard import batch_only_steps, check_streamable

__all__ = ["batch_only_steps", "check_streamable"]
