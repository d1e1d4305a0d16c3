"""Records of a text file that go over several lines, found in all parts of the file at once.

A file is read as chunks: what lies between two signs, line feeds say. Whether a sign ends a record depends on all that
precedes it, namely on whether a quoted text is open there and how deep it is nested. A chunk by itself tells how it changes
this state, for either state it may start in; and such changes can be put together before the state is known. So every
block of a file is summed up alone, a running sum over the blocks gives the state each of them starts in, and from there
each block is cut into records on its own. What a block starts with may belong to the last record of the one before;
these pieces, two to a block at most, are put together at the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidyveil.plans.lineage import cut_lineage
from tidyveil.sources.lines import BROADCAST_BYTES

_BLOCK = "file string, block bigint, open0 boolean, open1 boolean, deep0 bigint, deep1 bigint, n bigint"
_PIECE = "value binary, file string, block bigint, id bigint, part int"
#: What a piece is: a record, the end or the middle of one that an earlier block began, or the beginning of one.
WHOLE, HEAD, MIDDLE, TAIL = range(4)


def chunks_of(spark: SparkSession, paths: str | list[str], separator: str) -> DataFrame:
    """(value, file, block, id) for all that stands between separators; ``id`` grows inside a file's block."""
    return (
        spark.read.option("recursiveFileLookup", True).option("lineSep", separator).text(paths)
        .select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
        .withColumn("id", F.monotonically_increasing_id())
    )


def with_changes(chunks: DataFrame, leaves_open: Callable[[Column], Column], deeper: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds how each chunk changes the state: open0 and deep0 if it starts outside a quoted text, open1 and deep1 if inside.

    ``leaves_open`` and ``deeper`` tell of a text that starts outside whether it ends inside, and by how much it goes
    deeper; one that starts inside is taken as if a quote stood before it.
    """
    inside, quoted = F.concat(F.lit('"'), F.col("value")), F.contains("value", F.lit('"'))
    deep = deeper or (lambda text: F.lit(0).cast("bigint"))
    return chunks.withColumns(
        {
            "open0": F.when(quoted, leaves_open(F.col("value"))).otherwise(False),
            "open1": F.when(quoted, leaves_open(inside)).otherwise(True),
            "deep0": deep(F.col("value")),
            "deep1": F.when(quoted, deep(inside)).otherwise(F.lit(0)).cast("bigint"),
        }
    )


def block_starts(changes: DataFrame) -> DataFrame:
    """(file, block, open, deep, ends_open, ends_deep): the state before and after each block. One pass; a row for each block.

    The rows come from a stored copy, so that what reads them does not read the files again.
    """

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None  # file and block, then for both starts: inside or not, depth
        names = ["file", "block", "open0", "open1", "deep0", "deep1", "n"]

        def row() -> pa.RecordBatch:
            values = (*at, bool(state[0]), bool(state[1]), int(state[2]), int(state[3]), state[4])
            kinds = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            block, file = batch.column(1).to_numpy(), batch.column(0).dictionary_encode()
            codes = file.indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
            for first, last in zip([0, *edges], [*edges, batch.num_rows]):
                here = (file.dictionary[int(codes[first])].as_py(), int(block[first]))
                if here != at:
                    if at is not None:
                        yield row()
                    at, state = here, [False, True, 0, 0, 0]
                open0, open1, deep0, deep1 = (batch.column(k).slice(first, last - first).to_numpy(zero_copy_only=False) for k in range(2, 6))
                turns, fixed = open0 & ~open1, open0 == open1
                count = np.cumsum(turns)
                reset = np.maximum.accumulate(np.where(fixed, np.arange(last - first), -1))
                for k in (0, 1):
                    since = count - np.where(reset >= 0, count[reset], 0)
                    after = np.where(reset >= 0, open0[reset], state[k]) ^ (since % 2 == 1)
                    before = np.concatenate([[state[k]], after[:-1]])
                    state[2 + k] += int(np.where(before, deep1, deep0).sum())
                    state[k] = bool(after[-1])
                state[4] += last - first
        if at is not None:
            yield row()

    sums = cut_lineage(changes.select("file", "block", "open0", "open1", "deep0", "deep1").mapInArrow(sum_up, _BLOCK))
    # The same composition over the blocks of a file, of which there are few: the last block that ends alike from both
    # starts fixes the state, and every block after it that swaps them turns it.
    order = Window.partitionBy("file").orderBy("block")
    turns = F.when(F.col("open0") & ~F.col("open1"), 1).otherwise(0)
    turned = sums.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fixed = F.when(F.col("open0") == F.col("open1"), F.struct(F.col("open0").cast("int").alias("open"), "turned"))
    last = F.last(fixed, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    after = turned.withColumn("last", last).withColumn(
        "ends_open", (F.coalesce(F.col("last.open"), F.lit(0)) + F.col("turned") - F.coalesce(F.col("last.turned"), F.lit(0))) % 2 == 1
    )
    state = after.withColumn("open", F.coalesce(F.lag("ends_open").over(order), F.lit(False)))
    depth = F.when(F.col("open"), F.col("deep1")).otherwise(F.col("deep0"))
    ended = state.withColumn("ends_deep", F.sum(depth).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return cut_lineage(ended.select("file", "block", "open", (F.col("ends_deep") - depth).alias("deep"), "ends_open", "ends_deep"))


def _pieces(changes: DataFrame, starts: DataFrame, separator: str, level: int, only_broken: bool) -> DataFrame:
    """The blocks cut into pieces; of the blocks that begin or end within a record, only what is no whole record if asked."""
    glue = separator.encode()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, is_open, deep, clean, number, pending, first_id = None, False, 0, True, 0, [], 0

        def out(values: pa.Array, ids: np.ndarray, part: int) -> pa.RecordBatch:
            n = len(values)
            return pa.RecordBatch.from_arrays(
                [values, pa.array([at[0]] * n, pa.string()), pa.array(np.full(n, at[1], np.int64)), pa.array(ids, pa.int64()), pa.array(np.full(n, part, np.int32))],
                names=["value", "file", "block", "id", "part"],
            )

        def rest() -> Iterator[pa.RecordBatch]:
            if pending:
                yield out(pa.array([glue.join(pending)], pa.binary()), np.array([first_id + number]), TAIL if clean else MIDDLE)

        for batch in batches:
            if not batch.num_rows:
                continue
            value, blank = batch.column(0), batch.column(4).to_numpy(zero_copy_only=False)
            block, file, ids = batch.column(2).to_numpy(), batch.column(1).dictionary_encode(), batch.column(3).to_numpy()
            codes = file.indices.to_numpy()
            edges = np.flatnonzero((codes[1:] != codes[:-1]) | (block[1:] != block[:-1])) + 1
            changes_of = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5, 9)]
            start_open, start_deep = batch.column(9).to_numpy(zero_copy_only=False), batch.column(10).to_numpy()
            for first, last in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                here = (file.dictionary[int(codes[first])].as_py(), int(block[first]))
                if here != at:
                    yield from rest()
                    at, is_open, deep, number, pending, first_id = here, bool(start_open[first]), int(start_deep[first]), 0, [], int(ids[first])
                    clean = not is_open and deep == (level if here[1] else 0)
                open0, open1, deep0, deep1 = (c[first:last] for c in changes_of)
                turns, fixed = open0 & ~open1, open0 == open1
                count, reset = np.cumsum(turns), np.maximum.accumulate(np.where(fixed, np.arange(last - first), -1))
                after = np.where(reset >= 0, open0[reset], is_open) ^ ((count - np.where(reset >= 0, count[reset], 0)) % 2 == 1)
                depth = deep + np.cumsum(np.where(np.concatenate([[is_open], after[:-1]]), deep1, deep0))
                is_open, deep = bool(after[-1]), int(depth[-1])
                ends = np.flatnonzero(~after & (depth == level)) + 1
                if len(ends) and (pending or not clean):
                    pending += [x.as_py() for x in value.slice(first, int(ends[0]))]
                    whole = pa.array([glue.join(pending)], pa.binary())
                    if not clean or not only_broken:
                        yield out(whole, np.array([first_id + number]), WHOLE if clean else HEAD)
                    number += clean
                    pending, clean, begin, ends = [], True, int(ends[0]), ends[1:]
                else:
                    begin = 0
                if len(ends):
                    starts_at = np.concatenate([[begin], ends[:-1]])
                    single = ends - starts_at == 1
                    counted = ~(single & blank[first:last][ends - 1])  # a line without anything is no record
                    numbers = first_id + number + np.cumsum(counted) - 1
                    number += int(counted.sum())
                    if not only_broken:
                        keep = single & counted
                        yield out(value.take(pa.array(first + ends[keep] - 1)), numbers[keep], WHOLE)
                        several = [glue.join(x.as_py() for x in value.slice(first + int(a), int(b - a))) for a, b in zip(starts_at[~single], ends[~single])]
                        if several:
                            yield out(pa.array(several, pa.binary()), numbers[~single], WHOLE)
                    begin = int(ends[-1])
                pending += [x.as_py() for x in value.slice(first + begin, last - first - begin)]
        if at is not None:
            yield from rest()

    blank = (F.length(F.trim(F.regexp_replace("value", "\r$", ""))) == 0).alias("blank")
    own = starts.select(F.col("file").alias("of"), F.col("block").alias("at"), "open", "deep", "ends_open", "ends_deep")
    if only_broken:
        own = own.filter(f"open OR ends_open OR deep <> {level} OR ends_deep <> {level}")
    size = own.agg(F.sum(F.length("of") + 64)).first()[0] or 0
    is_here = (F.col("file") == F.col("of")) & (F.col("block") == F.col("at"))
    if size <= BROADCAST_BYTES:
        placed = changes.join(F.broadcast(own), is_here)
    else:  # the lines of a block come together again, in their order
        placed = changes.join(own, is_here).repartition("file", "block").sortWithinPartitions("file", "block", "id")
    columns = [F.col("value").cast("binary").alias("value"), "file", "block", "id", blank, "open0", "open1", "deep0", "deep1", "open", "deep"]
    return placed.select(*columns).mapInArrow(cut, _PIECE)


def records(changes: DataFrame, starts: DataFrame, separator: str, level: int = 0) -> DataFrame:
    """(value, file, block, id, whole) for each record: what lies between separators that stand outside quotes at depth ``level``.

    ``id`` numbers the records of a file's block from the id of its first chunk, those without anything left out;
    ``block`` is the one that a record begins in. ``whole`` is False for what follows the last end of a record in a file.
    """
    whole = _pieces(changes, starts, separator, level, False).filter(F.col("part") == WHOLE)
    broken = _pieces(changes, starts, separator, level, True).filter(F.col("part") != WHOLE)
    order = Window.partitionBy("file").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min_by(F.struct("block", "id"), F.struct("block", "part"))
    ended = F.max_by("part", F.struct("block", F.when(F.col("part") == TAIL, 1).otherwise(0))) == HEAD
    joined = (
        broken.withColumn("begun", F.count_if(F.col("part") == TAIL).over(order))
        .groupBy("file", "begun")
        .agg(F.sort_array(F.collect_list(F.struct("block", F.when(F.col("part") == TAIL, 1).otherwise(0).alias("k"), "value"))).alias("all"), first.alias("at"), ended.alias("whole"))
    )
    text = F.array_join(F.transform("all", lambda x: x["value"].cast("string")), separator)
    stitched = joined.select(text.alias("value"), "file", F.col("at.block").alias("block"), F.col("at.id").alias("id"), "whole")
    return whole.select(F.col("value").cast("string").alias("value"), "file", "block", "id", F.lit(True).alias("whole")).unionByName(stitched)
