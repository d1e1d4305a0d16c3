"""Reading and writing files."""

from tidyveil.sources.files import (
    read_csv,
    read_delimited,
    read_json,
    write_csv,
    write_delimited,
    write_json,
)
from tidyveil.sources.layout import detect_layout
from tidyveil.sources.paths import next_free, output_name, safe_output
from tidyveil.sources.rows import ROW_ORDER, with_row_id

__all__ = [
    "ROW_ORDER", "detect_layout", "next_free", "output_name", "read_csv", "read_delimited", "read_json",
    "safe_output", "with_row_id", "write_csv", "write_delimited", "write_json",
]
