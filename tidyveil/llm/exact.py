"""Exact dedup by content-defined chunks.

Texts are cut where their content says so, chunks become identifiers verified by comparing their bytes, and texts are
equal when their ordered lists of identifiers are. Each distinct chunk moves once per task; long documents never do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidyveil.llm.common import prepare, stored, text_of

#: Bytes of a chunk: the least, the mean beyond the least (a power of two), and the most.
LEAST, MEAN, MOST = 512, 2048, 16384
#: Bytes on which a cut depends, and the factor of the rolling hash over them.
REACH, FACTOR = 16, np.uint32(0x9E3779B1)


def cut_places(data: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of ``data`` (uint8); the last is its length, and empty data has none.

    A place may be an end if the hash of the ``REACH`` bytes before it is a multiple of ``mean``: equal stretches are
    cut alike, whatever precedes them.
    """
    if len(data) <= least:
        return [len(data)] if len(data) else []
    rolled = np.zeros(len(data) - REACH + 1, np.uint32)
    for k in range(REACH):
        rolled *= FACTOR
        rolled += data[k : k + len(rolled)]
    rolled ^= rolled >> np.uint32(15)
    may = np.flatnonzero((rolled & np.uint32(mean - 1)) == 0) + REACH
    ends, first = [], 0
    while len(data) - first > most or (len(may) and may[-1] >= first + least):
        at = np.searchsorted(may, first + least)
        end = int(min(may[at], first + most)) if at < len(may) else first + most
        if end >= len(data):
            break
        ends.append(end)
        first = end
    return [*ends, len(data)]


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [cut_places(np.frombuffer(x.as_buffer(), np.uint8)) if x.as_buffer().size else [] for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends, pa.list_(pa.int32()))], names=["id", "body", "ends"])


def _digest(chunk: Column) -> Column:
    return F.unhex(F.md5(chunk))


def _chunks() -> Column:
    """The chunks of ``body`` between the ``ends``."""
    first = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("ends", i - 1))
    return F.transform("ends", lambda end, i: F.substring("body", first(i) + 1, end - first(i)))


def recipes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=_digest) -> DataFrame:
    """id, text_sha256 (binary) and recipe of each row: the identifiers of its chunks in order, as fixed-width bytes.

    Two rows have equal recipes if and only if they have equal texts: an identifier is the digest of the chunk, and where
    chunks of equal digest differ in any byte, also their number among them.
    """
    prepare(df.sparkSession)
    source = df.select(F.col(doc_id).alias("id"), text_of(text).cast("binary").alias("body"))
    schema = source.select("*", F.array().cast("array<int>").alias("ends")).schema
    cut = source.mapInArrow(_cut, schema)

    # Verification: one row for each different chunk; digests with more than one such row clash.
    chunk = cut.select(F.explode(_chunks()).alias("chunk")).select(digest(F.col("chunk")).alias("digest"), "chunk")
    different = chunk.groupBy("digest", "chunk").agg(F.lit(1).alias("one"))
    clashing = stored(different.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest"), "clashes")

    sha = F.unhex(F.sha2("body", 256)).alias("text_sha256")
    if clashing.isEmpty():
        ids = F.transform(_chunks(), lambda c: F.concat(digest(c), F.lit(b"\x00\x00\x00\x01")))
        return cut.select("id", sha, F.coalesce(_joined(ids), F.lit(b"")).alias("recipe"))
    return _numbered(cut, sha, chunk, clashing, digest)


def _joined(ids: Column) -> Column:
    return F.aggregate(ids, F.lit(b""), lambda done, x: F.concat(done, x))


def _numbered(cut: DataFrame, sha: Column, chunk: DataFrame, clashing: DataFrame, digest) -> DataFrame:
    """The recipes where some digests clash: their chunks are numbered in the order of their bytes."""
    numbers = stored(
        chunk.join(clashing, "digest", "left_semi").distinct()
        .withColumn("number", F.row_number().over(Window.partitionBy("digest").orderBy("chunk"))), "numbers",
    )
    whole = stored(cut.select("id", sha, "body", "ends").withColumn("row", F.expr("uuid()")), "rows")
    parts = whole.select("row", F.posexplode(_chunks()).alias("at", "chunk")).select("row", "at", "chunk", digest(F.col("chunk")).alias("digest"))
    named = parts.join(numbers, ["digest", "chunk"], "left").select(
        "row", "at", F.concat("digest", F.unhex(F.lpad(F.hex(F.coalesce("number", F.lit(1))), 8, "0"))).alias("one")
    )
    lists = named.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "one"))).alias("ids"))
    return whole.join(lists, "row", "left").select(
        "id", "text_sha256", F.coalesce(_joined(F.transform("ids", lambda x: x["one"])), F.lit(b"")).alias("recipe")
    )


def exact_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", digest=_digest) -> DataFrame:
    """id, keep_id, group_size, kept and text_sha256 (binary) of every row; of equal texts the largest id stays.

    Missing texts equal empty ones. A missing id is less than any other; if all are missing, one row stays. Of rows that
    agree in id and text, exactly one can stay. An empty table gives no rows; other columns are not read.
    """
    listed = recipes(df, doc_id, text, digest)
    # Repeated rows are counted first, so that a group's one kept row is well defined.
    rows = stored(listed.groupBy("recipe", "id", "text_sha256").agg(F.count(F.lit(1)).alias("n")), "recipes")
    # Stored as well, so that both sides of the join come straight from their shuffles and a large group can be split.
    groups = stored(
        rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size")).select(F.col("recipe").alias("of"), "keep_id", "group_size"),
        "groups",
    )
    joined = rows.join(groups, rows["recipe"] == groups["of"])
    return joined.select(
        "id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"), "text_sha256"
    ).select("id", "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with all their columns. Of repeated rows (equal id and text) any one may stay."""
    fate = exact_groups(df, doc_id, text).groupBy(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha")).agg(
        F.max("kept").alias("__stays"), F.count(F.lit(1)).alias("__rows")
    ).filter("NOT __stays OR __rows > 1")
    marked = df.withColumn("__of", F.unhex(F.sha2(text_of(text), 256)))
    joined = marked.join(fate, marked[doc_id].eqNullSafe(fate["__id"]) & (marked["__of"] == fate["__sha"]), "left")
    single = joined.filter("__stays IS NULL").select(df.columns)
    return single.unionByName(joined.filter("__stays").dropDuplicates([doc_id, "__of"]).select(df.columns))


def copies_by_document(documents: DataFrame) -> DataFrame:
    groups = exact_groups(documents)
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("text_sha256")).alias("text_sha256"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))"""
