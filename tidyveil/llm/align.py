"""Alignment of two tokenizers over a corpus: which tokens of one cover the same bytes as tokens of the other.

Texts are shuffled as they are, so that each distinct one is tokenised and aligned once. Its pairs of linked tokens are
counted as often as the text occurs, and what was found comes back to the documents by the digest of their text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidyveil.llm.common import blocks, prepare, stored
from tidyveil.llm.word_bpe import byte_letters, unassigned

#: Texts longer than this many characters are tokenised in pieces, cut at a space between two other characters.
CUT = 1 << 16
#: Pairs that make up one of so many of all links or more are looked up in a table that is sent to all tasks; there can't
#: be more of them than this number. All other pairs are joined.
FREQUENT = 1 << 18

_AT_SPACE = regex.compile(r"(?<=\S) (?=\S)")
# How the piece tokenizer writes a space and single bytes.
_SPACE, _BYTE = "▁", regex.compile(r"<0x([0-9A-F]{2})>")
# How a byte-level tokenizer splits texts, and what its file says then.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def _quick(byte_file: str, a_bytes: list[bytes]) -> tiktoken.Encoding | None:
    """The same merges in a quicker library, where they are numbered in the order of their ids; else None."""
    with open(byte_file, encoding="utf-8") as file:
        spec = json.load(file)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or any(split.get(k) != v for k, v in _PLAIN.items()) or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [model["vocab"][a + b] for a, b in merges] != list(range(256, 256 + len(merges))) or any(len(a_bytes[i]) != 1 for i in range(256)):
        return None
    ranks = {a_bytes[i]: i for i in range(256 + len(merges))}
    return tiktoken.Encoding("bytes", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    """A byte-level tokenizer (A), which is given a space before the text, and one of pieces (B), which adds it."""

    def __init__(self, byte_file: str, piece_file: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on every core
        self.bytes_of_letter = {c: b for b, c in enumerate(byte_letters())}
        self.a = Tokenizer.from_file(byte_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_file)
        by_id = sorted(self.a.get_vocab(with_added_tokens=True).items(), key=lambda x: x[1])
        self.a_bytes = [b""] * (by_id[-1][1] + 1)
        for token, i in by_id:
            known = all(c in self.bytes_of_letter for c in token)
            self.a_bytes[i] = bytes(self.bytes_of_letter[c] for c in token) if known else token.encode()
        #: Characters that tables of another Unicode version may class otherwise are left to the tokenizer's own library.
        self.quick, self.unassigned = _quick(byte_file, self.a_bytes), unassigned()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace(_SPACE, " ").encode() for p in pieces]
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        #: No piece goes on from another character to a space, so what is left and right of such a place is merged alone.
        self.may_cut = not any(regex.search(f"[^{_SPACE}]{_SPACE}", p) for p in pieces)
        size = max(len(self.a_bytes), len(self.b_bytes))
        self._size, self._written = size, [f"{i}{end}" for end in ",|;" for i in range(size)]

    def _a(self, text: str) -> list[int]:
        if self.quick is None or not text.isascii() and self.unassigned[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any():
            return self.a.encode(text, add_special_tokens=False).ids
        return self.quick.encode_ordinary(text)

    def tokens(self, text: str, cut: int = CUT) -> tuple[list[int], list[int]]:
        first, a, b = 0, [], []
        while self.may_cut and len(text) - first > cut and (place := _AT_SPACE.search(text, first + cut)):
            a += self._a(" " + text[first : place.start()])
            b += self.b.encode(text[first : place.start()], num_threads=1)
            first = place.end()
        a += self._a(" " + text[first:])
        return a, b + self.b.encode(text[first:], num_threads=1)

    def align(self, text: str, cut: int = CUT) -> tuple[int, int, int, int, str, np.ndarray, np.ndarray] | None:
        """Numbers of A and B tokens, groups and links, the groups as text, linked pairs (A << 32 | B) and how often each.

        None where the tokens of A or B don't spell a space and the text, or there is none.
        """
        if not text:
            return None
        a, b = self.tokens(text, cut)
        whole = b" " + text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != whole or b"".join(map(self.b_bytes.__getitem__, b)) != whole:
            return None
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = self.a_length[a].cumsum(), self.b_length[b].cumsum()
        # Between two neighbouring ends of either kind lies one A and one B token, and no two stretches have the same ones.
        ends = np.concatenate([a_ends, b_ends])
        ends.sort(kind="stable")
        again = np.append(ends[1:] == ends[:-1], False)
        both, ends = ends[again], ends[~again]
        left, right = a[np.searchsorted(a_ends, ends)], b[np.searchsorted(b_ends, ends)]
        pairs, counts = np.unique(left << 32 | right, return_counts=True)
        return len(a), len(b), len(both), len(ends), self._groups(a, b, np.searchsorted(a_ends, both), np.searchsorted(b_ends, both)), pairs, counts

    def _groups(self, a: np.ndarray, b: np.ndarray, a_last: np.ndarray, b_last: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the tokens by group, A before B, with what stands behind each. Given the last tokens of groups."""
        a_sizes, b_sizes = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
        place = np.empty(len(a) + len(b), np.int64)
        # An A token stands behind the B tokens of earlier groups, a B token also behind the A tokens of its own.
        a_place = np.arange(len(a)) + np.repeat(b_last + 1 - b_sizes, a_sizes)
        b_place = np.arange(len(b)) + np.repeat(a_last + 1, b_sizes)
        place[a_place], place[b_place] = a, b
        place[a_place[a_last]] += self._size
        place[b_place[b_last]] += 2 * self._size
        return "".join(map(self._written.__getitem__, place.tolist()))[:-1]


@lru_cache(maxsize=2)
def aligner(byte_file: str, piece_file: str) -> Aligner:
    return Aligner(byte_file, piece_file)


_FIELDS = "n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<long>"


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """Every different text but the empty one, and in how many rows it stands (copies)."""
    texts = df.select(F.col(text).cast("string").alias("text")).filter("text <> ''")
    return texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies"))


def align(df: DataFrame, byte_file: str, piece_file: str, keep: list[str], text: str = "text", cut: int = CUT) -> DataFrame:
    """The columns ``keep`` and the alignment of each row's text: n_a, n_b, n_groups, n_links, groups, pairs, counts.

    ``groups`` lists the ids of A and B that end together, as in ``1,2|7;3|8,9``; ``pairs`` holds the different pairs of
    linked tokens as A << 32 | B, ``counts`` how many links of the text each has. A missing or empty text, and one that the
    tokens of either kind do not spell, has zeros, an empty string and empty lists. Equal rows give equal rows; an empty
    table gives none. Long texts are taken whole. Both files have the same path on every machine. Other columns are not read.
    """
    prepare(df.sparkSession)
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(text).cast("string"), F.lit("")).alias("groups"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(_FIELDS).fields])

    def lists(found: list, k: int) -> pa.Array:
        ends = np.cumsum([0, *(len(x[k]) for x in found)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *(x[k] for x in found)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, none = aligner(byte_file, piece_file).align, (0, 0, 0, 0, "", np.empty(0, np.int64), np.empty(0, np.int64))
        for batch in blocks(batches, len(keep)):
            found = [of(x.as_py(), cut) or none for x in batch.column(len(keep))]
            numbers = [pa.array([x[k] for x in found], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *numbers, pa.array([x[4] for x in found], pa.string()), lists(found, 5), lists(found, 6)], names=schema.names
            )

    return source.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """pair, count and is_best of every linked pair of ``aligned`` (columns pairs, counts, copies).

    ``count`` is how many links have the pair, a text's as often as it occurs; ``is_best`` says that no other pair with
    the same B has more.
    """
    each = aligned.select("copies", F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = stored(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum(F.col("x.counts") * F.col("copies")).alias("count")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("b")
    most = counts.groupBy(b).agg(F.max("count").alias("most"))
    return counts.withColumn("b", b).join(most, "b").select("pair", "count", (F.col("count") == F.col("most")).alias("is_best"))


def weighted(aligned: DataFrame, counts: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """``key`` and ``measures`` of ``aligned`` with n_best, its links whose pair is its B's best, and count_sum over its links.

    ``key`` tells the rows of ``aligned`` apart; ``counts`` is what ``pair_counts`` gave.
    """
    all_links = counts.agg(F.sum("count")).first()[0] or 0
    frequent = counts.filter(F.col("count") >= max(1.0, all_links / FREQUENT)).orderBy("pair").collect()  # FREQUENT rows at most
    table = [np.array([r[k] for r in frequent], t) for k, t in (("pair", np.int64), ("count", np.int64), ("is_best", bool))]
    sent = aligned.sparkSession.sparkContext.broadcast(table)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = sent.value
        for batch in batches:
            lists, times = batch.column(1), batch.column(2).flatten().to_numpy()
            these, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair, these), max(len(pair) - 1, 0))
            hit = pair[at] == these if len(pair) else np.zeros(len(these), bool)
            sums = [np.zeros(len(sizes), np.int64) for _ in range(2)]
            np.add.at(sums[0], row[hit], times[hit] * best[at[hit]])
            np.add.at(sums[1], row[hit], times[hit] * count[at[hit]])
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=len(sizes)))]), pa.int32())
            rest = [pa.ListArray.from_arrays(ends, pa.array(x[~hit])) for x in (these, times)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, sums), *rest], names=names)

    source = aligned.select(key, "pairs", "counts")
    names = [key, "n_best", "count_sum", "pairs", "counts"]
    schema = T.StructType([source.schema[key], *T._parse_datatype_string("n_best long, count_sum long, pairs array<long>, counts array<long>").fields])
    looked_up = source.mapInArrow(look_up, schema)
    rest = looked_up.select(key, F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select(key, F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    rare = rest.join(counts, "pair").select(key, F.when(F.col("is_best"), F.col("n")).otherwise(0).alias("n_best"), (F.col("n") * F.col("count")).alias("count_sum"))
    sums = looked_up.select(key, "n_best", "count_sum").unionByName(rare).groupBy(key).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return aligned.select(key, *measures).join(sums, key)


def alignment_by_document(documents: DataFrame, byte_file: str, piece_file: str) -> DataFrame:
    """The measures of every document's alignment, and the digest of its groups.

    Rows with a missing or empty text, or one that tokens don't spell, have zeros and no digest. Equal texts have equal
    measures, counted once for each row, repeated rows and missing ids included. An empty table gives no rows.
    """
    texts = distinct_texts(documents).withColumn("key", F.unhex(F.sha2("text", 256)))
    digest = F.when(F.col("n_links") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    found = align(texts, byte_file, piece_file, ["key", "copies"])
    aligned = stored(found.select(F.monotonically_increasing_id().alias("row"), "key", "copies", *numbers, digest, "pairs", "counts"), "aligned")
    counts = stored(pair_counts(aligned), "counts")
    # Stored, so that both sides of the next join come straight from their shuffles and a frequent text can be split.
    found = stored(weighted(aligned, counts, "row", ["key", *numbers, "groups_sha256"]).drop("row"), "measures")

    text = F.col("text").cast("string")
    has_text = F.coalesce(text != "", F.lit(False))
    keyed = documents.filter(has_text).select("doc_id", F.unhex(F.sha2(text, 256)).alias("key"))
    measures = [*numbers, "n_best", "count_sum", "groups_sha256"]
    zeros = [F.lit(0).cast("long").alias(c) for c in measures[:-1]] + [F.lit("").alias("groups_sha256")]
    return keyed.join(found, "key").select("doc_id", *measures).unionByName(documents.filter(~has_text).select("doc_id", *zeros))
