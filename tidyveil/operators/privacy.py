"""Masking, redaction, hashing and pseudonyms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidyveil.constants import MASK_CHAR, MASK_SHOW_LAST, PSEUDONYM_PREFIX, PSEUDONYM_SEED, REDACTED
from tidyveil.functions.columns import (
    as_text,
    has_column,
    is_missing,
    need_flat,
    ref,
    replace_column,
    text_column,
    type_of,
)
from tidyveil.functions.masking import hash_text, mask_text
from tidyveil.operators.lookup import BROADCAST_ROWS, attach_by_value

_LEAST_DIGITS = 3  # 4,096 buckets of the numbering, or 16 for each task of the session's shuffles if that is more
_FEW_BUCKETS = 1 << 16


def mask_column(df: DataFrame, column: str, mask_char: str = MASK_CHAR, show_last: int = MASK_SHOW_LAST) -> DataFrame:
    """Hide all but the last ``show_last`` characters; ``show_last=0`` hides every one."""
    if not has_column(df, column):
        return df
    return replace_column(df, column, mask_text(text_column(df, column), mask_char, int(show_last)))


def redact_column(df: DataFrame, column: str, replacement: str = REDACTED) -> DataFrame:
    """Every value becomes ``replacement``; missing cells stay missing."""
    if not has_column(df, column):
        return df
    present = ~is_missing(ref(column), type_of(df, column))
    return replace_column(df, column, F.when(present, F.lit(replacement)))


def hash_column(df: DataFrame, column: str, algorithm: str = "sha256", salt: str = "") -> DataFrame:
    """Hexadecimal digest of ``salt`` followed by the value's text.

    A digest of guessable values (short ids, phone numbers) can be reversed by trying them all;
    a secret salt is what prevents it. Keep the salt out of saved specs. It comes from a table of one
    row, so that it stands in no plan or event log; only on streams, which take no such table, it does.
    """
    if not has_column(df, column):
        return df
    hidden = None
    if salt:
        hidden = F.lit(salt) if df.isStreaming else df.sparkSession.createDataFrame([(salt,)], "salt string").scalar()
    return replace_column(df, column, hash_text(text_column(df, column), algorithm, hidden))


def pseudonyms(values: DataFrame, prefix: str, seed: int) -> DataFrame:
    """Number the rows of ``values(key, copies)`` (distinct keys) in an order shuffled by ``seed``.

    The order is that of ``md5(seed:key)``. Its first digits deal the keys evenly into buckets; running
    totals over the bucket sizes (one small row each) turn places within a bucket into places
    overall, so no task sorts more than its bucket.
    """
    width = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(_LEAST_DIGITS, (width.bit_length() + 3) // 4 + 1)
    hashed = values.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("key")))).withColumn(
        "bucket", F.substring("h", 1, digits)
    )
    # Running totals in two levels: over the buckets of each group, and over the few groups.
    earlier = lambda window: F.coalesce(F.sum("size").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    group = F.substring("bucket", 1, (digits + 1) // 2)
    sizes = hashed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).withColumn("group", group)
    groups = sizes.groupBy("group").agg(F.sum("size").alias("size"))
    starts = groups.select(F.col("group").alias("g"), earlier(W.orderBy("group")).alias("start"))
    within = sizes.select("group", F.col("bucket").alias("b"), earlier(W.partitionBy("group").orderBy("bucket")).alias("within"))
    offsets = within.join(F.broadcast(starts), F.col("group") == F.col("g")).select("b", (F.col("start") + F.col("within")).alias("before"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("h", "key"))
    few = 16**digits <= _FEW_BUCKETS  # otherwise the join finds both sides dealt out by bucket
    numbered = hashed.withColumn("place", place).join(F.broadcast(offsets) if few else offsets, F.col("bucket") == F.col("b"))
    number = (F.col("place") + F.col("before")).cast("string")
    padded = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return numbered.select("key", F.concat(F.lit(f"{prefix}_"), padded).alias("payload"), "copies")


def pseudonymize_column(
    df: DataFrame,
    column: str,
    prefix: str = PSEUDONYM_PREFIX,
    seed: int = PSEUDONYM_SEED,
    stats_from: DataFrame | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Equal values get equal labels ``prefix_0001`` …, different values different ones.

    Labels are dealt out in an order set by ``seed``, so they do not tell the order of the values.
    One aggregate over this column runs at once to number its distinct values. More than ``broadcast_rows`` of them, or
    wide ones, are joined by a shuffle.
    """
    if not has_column(df, column):
        return df
    dtype = need_flat(df, column)
    base = df if stats_from is None else stats_from
    values = (
        base.select(as_text(ref(column), dtype).alias("key"))
        .filter("key is not null")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    keyed = df.withColumn("__text", as_text(ref(column), dtype))
    labelled = attach_by_value(keyed, "__text", pseudonyms(values, prefix, seed), broadcast_rows)
    return replace_column(labelled, column, F.col("__payload")).select(*map(ref, df.columns))
