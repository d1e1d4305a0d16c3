"""Lines of text files with their place in the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table with a row for each file is broadcast up to this size.
BROADCAST_BYTES = 128 << 20


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(value, file, block, id) for each line that is not blank.

    Inside one file ``id`` grows line by line; the least ``id`` of a file's block 0 is its first line.
    """
    return (
        spark.read.option("recursiveFileLookup", True)
        .text(paths)
        .select(
            "value",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
        )
        .filter(F.length(F.trim("value")) > 0)
        .withColumn("id", F.monotonically_increasing_id())
    )


def first_value(value: Column, order: Column) -> Column:
    """``value`` of the least ``order`` in a group.

    By itself ``min_by`` of a text has Spark sort all rows by group; beside a set, whose state is an object, it hashes them.
    """
    return F.when(F.size(F.collect_set(F.when(order.isNotNull(), F.lit(True)))) > 0, F.min_by(value, order))


def few_files(lines: DataFrame) -> bool:
    """Whether a table with a row per file is small enough to broadcast; Spark has the listing."""
    return sum(len(f) + 32 for f in lines.inputFiles()) <= BROADCAST_BYTES


def first_ids(lines: DataFrame) -> DataFrame:
    """(of, first): each file and the id of its first line."""
    first = lines.filter("block = 0").groupBy(F.col("file").alias("of")).agg(F.min("id").alias("first"))
    return F.broadcast(first) if few_files(lines) else first


def without_head(lines: DataFrame, count: int) -> DataFrame:
    """Drop the first ``count`` lines of every file. They lie in its first block, so later blocks are not looked at."""
    if count <= 0:
        return lines
    first = F.col("file") == F.col("of")
    if few_files(lines):
        later = (F.col("block") > 0) | (F.col("id") >= F.col("first") + count)
        return lines.join(first_ids(lines), first).filter(later).drop("of", "first")
    # A join by file would gather each file's lines: only those of first blocks take part in it.
    begun = lines.filter("block = 0").join(first_ids(lines), first).filter(F.col("id") >= F.col("first") + count).drop("of", "first")
    return begun.unionByName(lines.filter("block > 0"))


def head_lines(lines: DataFrame, count: int) -> DataFrame:
    """(file, row, value): the first ``count`` lines of every file, numbered from 0."""
    return (
        lines.filter("block = 0")
        .join(first_ids(lines), F.col("file") == F.col("of"))
        .select("file", (F.col("id") - F.col("first")).alias("row"), "value")
        .filter(F.col("row") < count)
    )


def file_encodings(lines: DataFrame) -> DataFrame:
    """(file, is_utf8): whether every line of the file is valid UTF-8."""
    return lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("is_utf8"))


def as_latin1(value: str = "value"):
    return F.decode(F.col(value).cast("binary"), "ISO-8859-1")
