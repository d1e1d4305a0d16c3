"""Attaching a per-value result (a label, a mark) to every row that holds the value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.functions.columns import ref
from tidyveil.plans.lineage import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
HOT_SHARE = 1e-4  # at most 1 / HOT_SHARE values can each hold this share of the rows
_SCATTER = 1 << 20
#: Longer values are told by their digest where they are broadcast, so the hot ones take a few megabytes at most.
_LONG_BYTES = 256


def attach_by_value(
    df: DataFrame,
    key: str,
    mapping: DataFrame,
    broadcast_rows: int = BROADCAST_ROWS,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Left-join ``mapping(key, payload, copies)`` to ``df`` on text column ``key``; adds ``__payload``.

    The mapping (one row per distinct value) is stored and measured first. Small enough, it is
    broadcast and ``df`` is not shuffled at all. Otherwise ``df`` is shuffled on the value, except
    that the rows of hot values, which are few by arithmetic, get their payload by broadcast and
    are scattered evenly, as are rows without a value, so that no task gets one value's bulk.
    """
    stored = cut_lineage(mapping.select("key", "payload", "copies"))
    rows, size, copies = stored.agg(
        F.count(F.lit(1)),
        F.coalesce(F.sum(F.octet_length("key") + F.coalesce(F.octet_length("payload"), F.lit(0))), F.lit(0)),
        F.coalesce(F.sum("copies"), F.lit(0)),
    ).first()
    slim = stored.select(F.col("key").alias("__key"), F.col("payload").alias("__payload"))
    if rows <= broadcast_rows and size <= broadcast_bytes:
        return df.join(F.broadcast(slim), ref(key) == F.col("__key"), "left").drop("__key")

    is_hot = F.col("copies") >= F.lit(max(copies * HOT_SHARE, 1.0))
    short = lambda c: F.when(F.octet_length(c) <= _LONG_BYTES, c).otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))
    hot = stored.filter(is_hot).select(short(F.col("key")).alias("__hot"), F.col("payload").alias("__hot_payload"))
    cold = stored.filter(~is_hot).select(
        F.col("key").alias("__key"), F.col("payload").alias("__cold_payload"), F.lit(0).alias("__to")
    )
    spread = df.join(F.broadcast(hot), short(ref(key)) == F.col("__hot"), "left").withColumn(
        "__salt",
        F.when(
            F.col("__hot").isNotNull() | ref(key).isNull(),
            1 + F.pmod(F.xxhash64(*map(ref, df.columns)), F.lit(_SCATTER)),
        ).otherwise(0).cast("int"),
    )
    joined = spread.join(cold, (ref(key) == F.col("__key")) & (F.col("__salt") == F.col("__to")), "left")
    return joined.select(
        *map(ref, df.columns), F.coalesce("__hot_payload", "__cold_payload").alias("__payload")
    )
