"""Byte-level BPE: texts to token ids by a rank file, and ids back to bytes.

The merges are those of the ``tiktoken`` library, run on Arrow batches where Spark put the rows; no shuffle.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.llm.common import prepare, text_of

#: Texts longer than this many characters are cut before they are matched, at places where every match ends.
CUT = 1 << 15

# The characters that Unicode calls White_Space.
_SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: No match goes on from another character to white space, and a run of white space before another character is
#: matched up to its last one. These are the safe places.
_SAFE = regex.compile(rf"(?<=[^{_SPACE}])(?=[{_SPACE}])|(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")


@lru_cache(maxsize=4)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    """The tokenizer of a rank file (lines of base64 and rank), loaded once in each Python worker."""
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def pieces(text: str, cut: int = CUT) -> Iterator[str]:
    """``text`` in pieces that are encoded alone as they would be within it; about ``cut`` long where safe places allow."""
    first = 0
    while len(text) - first > cut:
        place = _SAFE.search(text, first + cut)
        if place is None:
            break
        yield text[first : place.start()]
        first = place.start()
    yield text[first:]


def _with_column(batch: pa.RecordBatch, column: pa.Array, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], column], names=names)


def encode(
    df: DataFrame, ranks: str, pattern: str, keep: list[str], text: str = "text", out: str = "tokens", cut: int = CUT
) -> DataFrame:
    """The columns ``keep`` and the token ids of each text as an array of int, without special tokens.

    ``ranks`` is the path of the rank file, the same on every machine; ``pattern`` splits a text before merging.
    A missing or empty text gives an empty array; equal rows give equal rows, an empty table an empty one. Other
    columns are not read, whatever their names; ``out`` must not be in ``keep``.
    """
    prepare(df.sparkSession)
    source = df.select(*[F.col(c) for c in keep], text_of(text).alias(out))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoding(ranks, pattern).encode_ordinary
        for batch in batches:
            ids, ends = array("i"), [0]
            for value in batch.column(len(keep)):
                whole = value.as_py()
                for piece in (whole,) if len(whole) <= cut else pieces(whole, cut):
                    ids.extend(of(piece))
                ends.append(len(ids))
            values = pa.array(np.frombuffer(ids, np.int32) if ids else np.empty(0, np.int32))
            yield _with_column(batch, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), [*keep, out])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, pattern: str, keep: list[str], tokens: str = "tokens", out: str = "bytes") -> DataFrame:
    """The columns ``keep`` and the bytes that each array of token ids stands for.

    The bytes need not be valid UTF-8 where ids were cut. A missing or empty array gives no bytes; an id without a
    token raises. ``out`` must not be in ``keep``; other columns are not read.
    """
    prepare(df.sparkSession)
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(tokens), F.array().cast("array<int>")).alias(out))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = encoding(ranks, pattern).decode_bytes
        for batch in batches:
            lists = batch.column(len(keep))
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            whole = [of(ids[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])]
            yield _with_column(batch, pa.array(whole, pa.binary()), [*keep, out])

    return source.mapInArrow(run, schema)


def digest_of_ids(tokens: str):
    """SHA-256 of the decimal ids joined by single spaces."""
    return F.sha2(F.array_join(F.col(tokens).cast("array<string>"), " "), 256)


def tokens_by_document(documents: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Number of tokens, digest of the ids, and digest of the bytes they decode to, of every document."""
    encoded = encode(documents, ranks, pattern, ["doc_id"]).select(
        "doc_id", F.size("tokens").cast("long").alias("n_tokens"), digest_of_ids("tokens").alias("ids_sha256"), "tokens"
    )
    back = decode(encoded, ranks, pattern, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
