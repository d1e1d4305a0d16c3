"""What the operators share: stored intermediate tables, bounded Arrow batches, plain text columns."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyveil.plans.lineage import shared_folder

#: Bytes of text in one Arrow batch, and in one block that a task holds as Python objects; rows of a block.
BATCH_BYTES, BLOCK_BYTES, BLOCK_ROWS = 8 << 20, 1 << 20, 60_000


def text_of(name: str) -> Column:
    """The text of a row; a missing one counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder not used before, in the storage all executors share (``spark.checkpoint.dir``)."""
    return f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: computed once, safe when executors are lost."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Before Python runs in tasks: send this package to the executors, bound Arrow batches by bytes unless that is done."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(), os.path.basename(package))  # the driver hands it out from there
        context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(context.applicationId)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(key, str(2**31 - 1))).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def blocks(batches: Iterator[pa.RecordBatch], text: int = 1, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of at most ``most`` bytes of text, or of one longer text."""
    for batch in batches:
        ends = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(ends.searchsorted(before + most, side="right")))
            last = min(last, first + BLOCK_ROWS)
            yield batch.slice(first, last - first)
            first = last
