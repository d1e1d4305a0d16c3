"""Fingerprints of files and of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyveil.functions.columns import as_text, is_nested, ref

_PIECE = 15  # hexadecimal digits that fit a bigint


def _sums(digest: Column) -> list[Column]:
    """Four sums of pieces of a SHA-256 text: a figure that does not depend on the order of rows."""
    return [
        F.sum(F.conv(F.substring(digest, 1 + i * _PIECE, _PIECE), 16, 10).cast("decimal(38,0)")).alias(f"s{i}")
        for i in range(4)
    ]


def _seal(counted: Column) -> Column:
    parts = [F.coalesce(F.col(f"s{i}"), F.lit(0)).cast("string") for i in range(4)]
    return F.sha2(F.concat_ws(":", counted.cast("string"), *parts), 256)


def row_digest(df: DataFrame) -> Column:
    """SHA-256 of a row's cells: lengths written out, so cell borders and missing cells count."""
    parts = []
    for f in df.schema.fields:
        text = F.to_json(F.struct(ref(f.name))) if is_nested(f.dataType) else as_text(ref(f.name), f.dataType)
        parts.append(F.coalesce(F.concat(F.char_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat_ws(",", *parts), 256)


def table_fingerprint(df: DataFrame, strong: bool = False) -> DataFrame:
    """One row (rows, fingerprint), alike for equal tables however their rows are spread.

    The plain form adds up 64-bit row hashes: fast, and enough to notice accidental change. The
    ``strong`` form adds up pieces of a SHA-256 per row, against deliberate change.
    """
    if strong:
        return df.select(row_digest(df).alias("d")).agg(F.count(F.lit(1)).alias("rows"), *_sums(F.col("d"))).select(
            "rows", _seal(F.col("rows")).alias("fingerprint")
        )
    hashed = df.select(F.xxhash64(*[F.to_json(F.struct(ref(f.name))) if is_nested(f.dataType) else ref(f.name) for f in df.schema.fields]).alias("h"))
    return hashed.agg(
        F.count(F.lit(1)).alias("rows"),
        F.bit_xor("h").alias("x"),
        F.sum(F.col("h").cast("decimal(38,0)")).alias("s"),
    ).select(
        "rows",
        F.md5(
            F.concat_ws(
                ":",
                F.col("rows").cast("string"),
                F.coalesce("x", F.lit(0)).cast("string"),
                F.coalesce("s", F.lit(0)).cast("string"),
            )
        ).alias("fingerprint"),
    )


def file_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, digest) of each file under ``path``, by one rule for every size.

    The digest seals the sums of the SHA-256 of every line with its number before it, from 0, and the number of lines; lines end at
    line feeds, and carriage returns belong to them. Spark lists no empty files. Moving, changing, adding or re-encoding a line changes it, as
    does, through the bytes, an end of line more or less. Files are split over tasks; it does not depend on how.
    """
    lines = (
        spark.read.option("recursiveFileLookup", True).option("lineSep", "\n").text(path)
        .select(
            F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("bytes"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"),
        )
    )
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("file").alias("of"), F.col("block").alias("at"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    number = (F.col("id") + F.col("shift")).cast("string").cast("binary")
    hashed = lines.join(starts, (F.col("file") == F.col("of")) & (F.col("block") == F.col("at"))).select(
        "file", "bytes", F.sha2(F.concat(number, F.lit(b":"), F.col("value")), 256).alias("d")
    )
    return hashed.groupBy("file", "bytes").agg(F.count(F.lit(1)).alias("n"), *_sums(F.col("d"))).select("file", "bytes", _seal(F.col("n")).alias("digest"))


def files_fingerprint(spark: SparkSession, path: str) -> str:
    """One digest for all files under ``path``, whatever their names."""
    each = F.sha2(F.concat_ws(":", "bytes", "digest"), 256)
    row = file_fingerprints(spark, path).select(each.alias("d")).agg(F.count(F.lit(1)).alias("files"), *_sums(F.col("d"))).select(_seal(F.col("files")).alias("digest")).first()
    return row["digest"]
