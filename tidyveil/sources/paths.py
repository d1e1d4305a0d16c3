"""File-system checks through Hadoop's API, so they hold for any store Spark can reach."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession

from tidyveil.constants import OUTPUT_SUFFIX
from tidyveil.errors import OutputError


def _open(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _open(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    fs, where = _open(spark, path)
    return fs.makeQualified(where).toString().rstrip("/")


def content_bytes(spark: SparkSession, path: str) -> int:
    fs, where = _open(spark, path)
    return int(fs.getContentSummary(where).getLength())


def output_name(source: str) -> str:
    """``orders.csv`` becomes ``orders_sanitized.csv``."""
    stem, suffix = posixpath.splitext(posixpath.basename(source.rstrip("/")))
    return f"{stem}{OUTPUT_SUFFIX}{suffix}"


def next_free(spark: SparkSession, path: str) -> str:
    """``path`` if nothing is there, else ``name (n)`` with n one more than the largest beside it, 2 at least."""
    fs, where = _open(spark, path)
    if not fs.exists(where):
        return path
    stem, suffix = posixpath.splitext(path)
    name = re.compile(rf"{re.escape(posixpath.basename(stem))} \((\d+)\){re.escape(suffix)}")
    beside = (name.fullmatch(s.getPath().getName()) for s in fs.listStatus(where.getParent()))
    return f"{stem} ({max([1, *(int(m[1]) for m in beside if m)]) + 1}){suffix}"


def safe_output(spark: SparkSession, source: str, output: str, on_exists: str = "version") -> str:
    """Where to write: never over the source, nor silently over anything else.

    An existing folder with no data of ours in its name takes ``<source>_sanitized`` inside it when
    ``output`` ends in a slash. ``on_exists`` is ``"version"``, ``"replace"`` or ``"error"``.
    """
    target = output.rstrip("/") + "/" + output_name(source) if output.endswith("/") else output
    here, there = qualified(spark, source), qualified(spark, target)
    if here.lower() == there.lower() or here.startswith(there + "/") or there.startswith(here + "/"):
        raise OutputError(f"output {target!r} and source {source!r} overlap")
    if on_exists == "version":
        return next_free(spark, target)
    if on_exists == "error" and exists(spark, target):
        raise OutputError(f"{target!r} already exists")
    if on_exists not in ("replace", "error"):
        raise OutputError(f"on_exists must be 'version', 'replace' or 'error', not {on_exists!r}")
    return target


def check_written(spark: SparkSession, path: str, data: DataFrame) -> None:
    """Raise unless ``data`` left something at ``path``; only a table without rows may leave no bytes."""
    if not exists(spark, path):
        raise OutputError(f"nothing was written to {path!r}")
    if content_bytes(spark, path) == 0 and not data.isEmpty():
        raise OutputError(f"the output at {path!r} is empty")
