"""Near-duplicate documents by SimHash, linked through a Golay code.

The binary Golay code of length 23 is perfect: every word lies within distance 3 of exactly one codeword, and a word at
distance 3 has five more at distance 4. Two words that differ in at most one bit therefore share one of the (one or six)
codewords within distance 4 of each. A fingerprint of 64 bits is cut into three segments. Of three errors or fewer,
either one segment has none and another at most one, or each has exactly one, and then one half of each has none. Every
case gives a key of about 34 bits made of exact bits and a codeword's index; fingerprints with a key in common are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidyveil.llm.common import blocks, prepare, stored, text_of
from tidyveil.llm.graph import components

# The seed of the shingles' hash, the generator polynomial of the Golay code.
SEED = 42
GENERATOR = 0b110001110101

#: Bits that linked fingerprints may differ in. The keys below are made for three.
MOST_BITS = 3
#: Segments of a fingerprint: first bit and length.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Fingerprints that are compared with each other at once.
BLOCK = 2048


def fingerprint_of(text: bytes, words: int = 3) -> int:
    """Bit by bit the majority of the hashes of all shingles, repeats included."""
    parts = text.lower().split()  # both deal with ASCII alone
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    width = min(words, len(parts))
    first = np.concatenate([[0], ends[: len(parts) - width] + 1]).tolist()
    of = xxhash.xxh64_intdigest
    hashes = np.array([of(joined[a:b], SEED) for a, b in zip(first, ends[width - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id and fingerprint (bigint, its 64 bits) of every row. No words: zero."""
    prepare(df.sparkSession)
    source = df.select(F.col(doc_id).alias("id"), text_of(text).cast("binary").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches):
            found = [fingerprint_of(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["id", "fingerprint"])

    return source.mapInArrow(run, source.select("id", F.lit(0).cast("long").alias("fingerprint")).schema)


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of all words of 23 bits in two tables of 12 and 11 bits joined, then by remainder: error, other errors."""
    rest = []
    for bit in range(23):
        value = 1 << bit
        for k in range(bit, 10, -1):
            if value >> k & 1:
                value ^= GENERATOR << (k - 11)
        rest.append(value)
    remainder = np.zeros(1 << 23, np.int16)
    for bit in range(23):
        remainder[1 << bit : 2 << bit] = remainder[: 1 << bit] ^ rest[bit]
    leader, others = np.zeros(1 << 11, np.int32), [[] for _ in range(1 << 11)]
    for weight in range(1, 5):
        for places in combinations(range(23), weight):
            error = sum(1 << p for p in places)
            if weight < 4:
                leader[remainder[error]] = error
            else:
                others[remainder[error]].append(error)
    return remainder, leader, np.array([(x + [0] * 5)[:5] for x in others], np.int32)


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``words`` (23 bits each) and the indices of the codewords within distance 4, one or six for each."""
    remainder, leader, others = _golay()
    rest = remainder[words]
    nearest = (words ^ leader[rest]) >> 11
    six = np.flatnonzero(others[rest, 0])
    more = (words[six, None] ^ others[rest[six]]) >> 11
    return np.concatenate([np.arange(len(words)), np.repeat(six, 5)]), np.concatenate([nearest, more.ravel()]).astype(np.int64)


def keys_of(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and their fingerprints (both int64), one kind of key after another."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    coded = [codewords(p) for p in parts]
    kind = 0
    for exact in range(3):
        for other in range(3):
            if other != exact:
                rows, index = coded[other]
                yield kind << 40 | parts[exact][rows] << 12 | index, prints[rows]
                kind += 1
    rows, index = coded[0]
    half = lambda part, up: (part >> 11 if up else part & 0x7FF)[rows]
    for left in (False, True):
        for right in (False, True):
            yield kind << 40 | half(parts[1], left) << 23 | half(parts[2], right) << 12 | index, prints[rows]
            kind += 1


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, prints in keys_of(batch.column(0).to_numpy()):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(prints)], names=["key", "fp"])


def _are_near(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.bitwise_count((one ^ other).view(np.uint64)) <= MOST_BITS  # of signed numbers it counts the bits of the absolute


def spanning_links(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join what is near within ``left``, or between ``left`` and ``right``: no more than join the groups."""
    nodes = left if right is None else np.concatenate([left, right])
    group, links = np.arange(len(nodes)), []
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        near = np.flatnonzero(_are_near(nodes[start:], nodes[i])) + start
        for j in near[group[near] != group[i]]:
            if group[j] != group[i]:
                links.append((int(nodes[i]), int(nodes[j])))
                group[group == group[j]] = group[i]
    return links


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("block", pa.int32()), ("fps", pa.list_(pa.int64()))])


def _batch(links: np.ndarray, parts: list[tuple[int, int, np.ndarray]] = ()) -> pa.RecordBatch:
    pairs = links.reshape(-1, 2)
    n, m = len(pairs), len(parts)
    fps = pa.array([None] * n + [p[2].tolist() for p in parts], pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(pairs[:, 0].tolist() + [None] * m, pa.int64()), pa.array(pairs[:, 1].tolist() + [None] * m, pa.int64()),
            pa.array([None] * n + [p[0] for p in parts], pa.int64()), pa.array([None] * n + [p[1] for p in parts], pa.int32()), fps,
        ],
        schema=_LINKS,
    )


def _link_runs(batches: Iterator[pa.RecordBatch], most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by key. Links within each run of a key; a run over ``most`` is handed on in blocks."""
    key, fps, handed = np.empty(0, np.int64), np.empty(0, np.int64), 0  # of the last run, and its blocks handed on
    for batch in chain(batches, [None]):
        over = batch is None
        if not over:
            key, fps = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fps, batch.column(1).to_numpy()])
        if not len(key):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size, at = np.diff(np.append(starts, len(key))), np.arange(len(starts))
        is_open, goes_on = (at == at[-1]) & (not over), (at == 0) & (handed > 0)
        pair = starts[(size == 2) & ~is_open & ~goes_on]
        near = pair[_are_near(fps[pair], fps[pair + 1])]
        links, parts, rest, count = [], [], fps[:0], 0
        for k in np.flatnonzero((size > 2) | is_open | goes_on):
            run, number = fps[starts[k] : starts[k] + size[k]], handed if k == 0 else 0
            if not is_open[k] and not number and len(run) <= most:
                links += spanning_links(run)
                continue
            while len(run) > (most if is_open[k] else 0):
                parts.append((int(key[starts[k]]), number, run[:most]))
                run, number = run[most:], number + 1
            if is_open[k]:
                rest, count = run, number
        yield _batch(np.stack([fps[near], fps[near + 1]], axis=1))
        yield _batch(np.array(links, np.int64), parts)
        key, fps, handed = key[len(key) - len(rest) :], rest, count


def _link_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for left, right, same in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found = spanning_links(np.array(left, np.int64), None if same else np.array(right, np.int64))
            yield pa.RecordBatch.from_arrays(list(map(pa.array, np.array(found, np.int64).reshape(-1, 2).T)), names=["a", "b"])


def near_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints (column fp, each once) that join all within three bits of each other.

    Groups of near fingerprints get links enough to be joined, not all pairs. Fingerprints under one key are compared in
    blocks; a key with more than a block is spread over tasks as pairs of blocks.
    """
    keyed = prints.select("fp").mapInArrow(_keyed, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    runs = stored(dealt.mapInArrow(_link_runs, "a long, b long, key long, block int, fps array<long>"), "runs")
    plain, parts = runs.filter("a IS NOT NULL").select("a", "b"), runs.filter("key IS NOT NULL").select("key", "block", "fps")
    other = parts.select("key", F.col("block").alias("later"), F.col("fps").alias("more"))
    pairs = parts.join(other, "key").filter("block <= later").select("fps", "more", (F.col("block") == F.col("later")).alias("same"))
    return plain.unionByName(pairs.repartition("fps", "more").mapInArrow(_link_blocks, "a long, b long")).distinct()


def near_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """id, fingerprint and component_id, the least id of all documents reached over links, of every row.

    Fingerprints link when they differ in at most three bits. Missing and empty texts have fingerprint zero and link like
    any other; fewer than ``words`` words are one shingle; repeated rows share their group. Missing ids don't count for
    component_id, which is missing where a group has no other. No rows: none. Other columns are not read.
    """
    rows = stored(fingerprints(df, doc_id, text, words), "fingerprints")
    prints = stored(rows.groupBy(F.col("fingerprint").alias("fp")).agg(F.min("id").alias("first")), "prints")
    roots = components(near_links(prints))
    placed = prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stored(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, rows["fingerprint"] == classes["fp"]).select("id", "fingerprint", "component_id")


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """The rows of ``df``, with all their columns, that are the first of their group by id."""
    gone = near_groups(df, doc_id, text, words).filter("id <> component_id").select(F.col("id").alias("__gone")).distinct()
    return df.join(gone, df[doc_id] == gone["__gone"], "left_anti")


def groups_by_document(documents: DataFrame) -> DataFrame:
    return near_groups(documents).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )
