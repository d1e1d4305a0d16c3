"""Benchmark decontamination: which documents hold passages of benchmark items.

A set join with prefix filtering. Item windows and documents are sets of short word shingles. Shingles are ordered by
how often they occur in all documents; a window that a document contains wholly must have its rarest shingle in it, so
that one is the necessary prefix, and only documents' occurrences of prefixes are joined. The place of the shingle in the
window bounds where the window can lie, and the words there are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.llm.common import blocks, prepare, stored, text_of

#: Words of a window, and of the shingles that are looked for.
WINDOW, SHINGLE = 10, 3
#: Bits of the filter that tells which shingles of a document can be a benchmark's. Its size is fixed, whatever the
#: benchmark's is; a fuller filter lets more shingles through to the join, which decides.
FILTER_BITS = 23

_FACTORS = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Bytes to word bytes: A-Z to a-z; digits, a-z and all beyond ASCII as they are; the others part words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


#: Bytes whose words are hashed at once; the factor of the hash and its inverse modulo 2**64.
STEP, _ODD = 1 << 20, 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class _Hashes:
    """Hashes of words: the sum of a word's bytes times powers of an odd factor, for all words of a text at once."""

    def __init__(self) -> None:
        self.powers = self.inverse = np.ones(1, np.uint64)

    def _reach(self, n: int) -> None:
        if len(self.powers) < n:
            ones = np.ones(n, np.uint64)
            ones[1:] = _ODD
            self.powers = np.cumprod(ones)
            ones[1:] = _INVERSE
            self.inverse = np.cumprod(ones)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of the words at ``data[starts:ends]``, which come in order."""
        out, first = np.empty(len(starts), np.uint64), 0
        while first < len(starts):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + STEP, side="right")))
            part = data[starts[first] : ends[last - 1]]
            self._reach(len(part))
            total = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * self.powers[: len(part)], out=total[1:])
            at = starts[first:last] - starts[first]
            out[first:last] = (total[ends[first:last] - starts[first]] - total[at]) * self.inverse[at]
            first = last
        out ^= out >> np.uint64(32)
        out *= _FACTORS[1]
        return out ^ (out >> np.uint64(29))


def _places(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in folded texts that stand one behind the other, cut at ``offsets``."""
    word = np.zeros(len(data) + 2, bool)
    word[1:-1] = data != 32
    starts, ends = word[1:-1] & ~word[:-2], word[1:-1] & ~word[2:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    starts[cuts] = word[1:-1][cuts]
    ends[cuts - 1] = word[1:-1][cuts - 1]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash for each ``width`` consecutive words."""
    n = max(0, len(hashes) - width + 1)
    total = np.full(n, width, np.uint64)
    for k in range(width):
        total += hashes[k : k + n] * _FACTORS[k]
    total ^= total >> np.uint64(29)
    return total * _FACTORS[0]


def _windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """item, window (its words joined by spaces), size, and the shingles of the window in order."""
    source = items.select(F.col(item_id).cast("string").alias("item"), text_of(text).cast("binary").alias("body")).filter("item IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            rows = []
            for item, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(body)
                data = np.frombuffer(body.translate(_FOLD), np.uint8)
                values = hashes.of(data, *_places(data, np.empty(0, np.int64)))
                for at in range(max(1, len(words) - window + 1) if words else 0):
                    part = words[at : at + window]
                    shingles = _shingles(values[at : at + window], min(SHINGLE, len(part))).view(np.int64)
                    rows.append((item, b" ".join(part).decode(), len(part), shingles.tolist()))
            names = ["item", "window", "size", "shingles"]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int64())]
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return source.mapInArrow(run, "item string, window string, size int, shingles array<long>")


def _filter(shingles: DataFrame) -> np.ndarray:
    """Which of the values of the first FILTER_BITS bits the shingles have: at most 2**17 rows reach the driver."""
    top = F.shiftrightunsigned("shingle", 64 - FILTER_BITS)
    words = shingles.groupBy(F.shiftright(top, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(shingle, {64 - FILTER_BITS}) & 63 AS int))")).alias("bits"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for row in words.collect():
        table[row["at"]] = row["bits"]
    return table


def _found(hashes: np.ndarray, owner: np.ndarray, width: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the shingles that pass the filter and lie within one document, and these shingles."""
    shingles = _shingles(hashes, width)
    top = shingles >> np.uint64(64 - FILTER_BITS)
    passed = (table[(top >> np.uint64(6)).astype(np.int64)].view(np.uint64) >> (top & np.uint64(63))) & np.uint64(1)
    at = np.flatnonzero(passed)
    at = at[owner[at] == owner[at + width - 1]]
    return at, shingles[at].view(np.int64)


@dataclass
class _Words:
    """All words of a block of documents: the folded bytes, where words start and end there, their hashes, the document of each."""

    folded: bytes
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    owner: np.ndarray

    def joined(self, first: int, last: int) -> str:
        """The words from ``first`` to before ``last``, all of one document, parted by single spaces."""
        return b" ".join(self.folded[self.starts[first] : self.ends[last - 1]].split()).decode()


def _parsed(batches: Iterator[pa.RecordBatch], hashes: _Hashes) -> Iterator[tuple[pa.RecordBatch, _Words]]:
    """Of each block of documents: itself and its words."""
    for batch in blocks(batches):
        texts = [x.as_py() for x in batch.column(1)]
        folded = b"".join(texts).translate(_FOLD)
        offsets = np.cumsum([len(x) for x in texts])
        data = np.frombuffer(folded, np.uint8)
        starts, ends = _places(data, offsets)
        yield batch, _Words(folded, starts, ends, hashes.of(data, starts, ends), np.searchsorted(offsets, starts, side="right"))


def _occurrences(docs: DataFrame, table: np.ndarray, widths: list[int]) -> DataFrame:
    """shingle and n: how often each shingle of the benchmark occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for _, own in _parsed(batches, hashes):
            found, n = np.unique(np.concatenate([_found(own.hashes, own.owner, w, table)[1] for w in widths]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["shingle", "n"])

    return docs.select("id", "body").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _candidates(docs: DataFrame, table: np.ndarray, widths: list[int], window: int) -> DataFrame:
    """id, n_words, and of each prefix shingle found: it, its place, the words around it and the place of their first."""
    one = pa.struct([("shingle", pa.int64()), ("at", pa.int32()), ("first", pa.int32()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch, own in _parsed(batches, hashes):
            n = np.bincount(own.owner, minlength=batch.num_rows)
            starts = np.cumsum(n) - n
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for width in widths:
                for at, shingle in zip(*(x.tolist() for x in _found(own.hashes, own.owner, width, table))):
                    k = int(own.owner[at])
                    start, end = int(starts[k]), int(starts[k] + n[k])
                    low = max(start, at - window + 1)
                    around = own.joined(low, min(end, at + window))
                    found[k].append({"shingle": shingle, "at": at - start, "first": low - start, "around": around})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(found, pa.list_(one))], names=["id", "n_words", "found"])

    schema = T.StructType([
        docs.schema["id"], T.StructField("n_words", T.LongType()),
        T.StructField("found", T.ArrayType(T.StructType([
            T.StructField("shingle", T.LongType()), T.StructField("at", T.IntegerType()),
            T.StructField("first", T.IntegerType()), T.StructField("around", T.StringType()),
        ]))),
    ])
    return docs.select("id", "body").mapInArrow(run, schema)


def _covered(places: Column) -> Column:
    """How many words lie in any of ``places`` (start, size), ordered by start."""
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(s: Column, p: Column) -> Column:
        end = p["start"] + p["size"]
        return F.struct(F.greatest(s["end"], end).alias("end"), (s["n"] + F.greatest(end - F.greatest(s["end"], p["start"]), F.lit(0))).alias("n"))

    return F.aggregate(places, start, step, lambda s: s["n"])


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """id, n_words, n_hit, items (sorted array of string) and places (array of start, size) of every row of ``docs``.

    A window is ``window`` consecutive words of an item, or all words of a shorter one. Places are where windows occur,
    in words; n_hit counts the words in any of them; items are those whose windows occur. Missing and empty texts have no
    words, so no windows; items without an id are skipped and repeated items count once; each repeated document row gets
    its own equal row. Without items or documents nothing is hit. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    prepare(spark)
    source = docs.select(F.col(doc_id).alias("id"), text_of(text).cast("binary").alias("body"))
    windows = stored(
        _windows(items, item_id, item_text, window).groupBy("window", "size", "shingles").agg(F.collect_set("item").alias("items")), "windows"
    )
    shingles = windows.select("window", "size", "items", F.posexplode("shingles").alias("offset", "shingle"))
    widths = sorted({min(SHINGLE, r["size"]) for r in windows.select(F.least("size", F.lit(SHINGLE)).alias("size")).distinct().collect()}) or [1]

    counts = stored(_occurrences(source, _filter(shingles.select("shingle")), widths), "rarity")
    rarest = shingles.join(counts, "shingle").groupBy("window", "size").agg(
        F.min(F.struct("n", "offset", "shingle")).alias("r"), F.first("items").alias("items")
    )
    prefixes = stored(
        rarest.groupBy(F.col("r.shingle").alias("prefix")).agg(
            F.collect_list(F.struct(F.col("r.offset").alias("offset"), "size", "window", "items")).alias("windows")
        ), "prefixes",
    )
    table = _filter(prefixes.select(F.col("prefix").alias("shingle")))
    rows = stored(_candidates(source, table, widths, window).withColumn("row", F.monotonically_increasing_id()), "candidates")

    near = rows.select("row", "n_words", F.explode("found").alias("c")).join(prefixes, F.col("c.shingle") == F.col("prefix"))
    start = lambda w: F.col("c.at") - w["offset"]
    fits = lambda w: (start(w) >= 0) & (start(w) + w["size"] <= F.col("n_words"))
    # Words around a shingle reach from window - 1 before it to window - 1 after its first.
    same = lambda w: F.array_join(F.slice(F.split("c.around", " "), start(w) - F.col("c.first") + 1, w["size"]), " ") == w["window"]
    hits = near.select("row", F.transform(
        F.filter("windows", lambda w: F.when(fits(w), same(w)).otherwise(False)),
        lambda w: F.struct(start(w).alias("start"), w["size"].alias("size"), w["items"].alias("items")),
    ).alias("hits")).filter(F.size("hits") > 0)
    found = hits.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits")).select(
        F.col("row").alias("of"),
        F.array_sort(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"].alias("start"), h["size"].alias("size"))))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    )
    joined = rows.select("row", "id", "n_words").join(found, F.col("row") == F.col("of"), "left")
    none = F.array().cast("array<struct<start:int,size:int>>")
    return joined.select(
        "id", "n_words", F.coalesce(_covered(F.col("places")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("places", none).alias("places"),
    )


def without_passages(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, of which no word lies in an item's window.

    A row is told by its id and text, so rows that share an id are judged each by its own text.
    """
    marked = docs.withColumn("__of", F.xxhash64(text_of(text)))
    hit = find_passages(marked.select(F.struct(F.col(doc_id).alias("id"), "__of").alias("__key"), F.col(text).alias("text")), items, "__key")
    gone = hit.filter("n_hit > 0").select(F.col("id.id").alias("__id"), F.col("id.__of").alias("__hash")).distinct()
    kept = marked.join(gone, marked[doc_id].eqNullSafe(gone["__id"]) & (marked["__of"] == gone["__hash"]), "left_anti")
    return kept.select(docs.columns)


def passages_by_document(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_passages(documents, benchmark).select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark),
w AS (
  SELECT DISTINCT item_id, least(10, len(words)) AS size, array_to_string(words[i + 1:i + least(10, len(words))], ' ') AS win
  FROM (SELECT item_id, words, unnest(range(0, greatest(len(words) - 9, 1))) AS i FROM b WHERE len(words) > 0)),
sizes AS (SELECT DISTINCT size FROM w),
places AS (
  SELECT doc_id, size, i, array_to_string(words[i + 1:i + size], ' ') AS win
  FROM (SELECT doc_id, words, size, unnest(range(0, len(words) - size + 1)) AS i FROM d, sizes WHERE len(words) >= size)),
hit AS (SELECT doc_id, item_id, i, p.size FROM places p JOIN w ON p.win = w.win AND p.size = w.size),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id"""
