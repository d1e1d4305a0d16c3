"""BPE with word ends: texts to token ids by a tokenizer file, and ids back to text.

Words are merged by a priority queue of merge ranks over a doubly linked list of symbols. Entries of the queue are not
removed when their symbols change; they are skipped when their turn comes. Each Python worker keeps the words it has met.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidyveil.llm.common import prepare, text_of

#: Texts longer than this many characters are worked on in pieces, cut before spaces: no token holds one.
CUT = 1 << 16
#: Words that a worker remembers; it forgets all when there are more.
REMEMBERED = 1 << 18

# What the tokenizer file has to say for this module to give the ids its library gives.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False}


def byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabularies of byte-level tokenizers: itself if it is visible."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=1)
def unassigned() -> np.ndarray:
    """Which characters Python's tables don't know. Newer tables might: texts with them are left to the library's own."""
    return np.fromiter((unicodedata.category(chr(c)) == "Cn" for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


class _Known(dict):
    """Words that were met, with their ids."""

    def __init__(self, merged: Callable[[bytes], tuple[int, ...]]) -> None:
        self._merged = merged

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self._merged(word.encode())
        if len(word) < 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = found
        return found


class WordBpe:
    """A tokenizer file, read once in each worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"]
        if (
            spec["normalizer"].get("normalizers") != _NORMAL or spec["decoder"] or any(model[k] != v for k, v in _MODEL.items())
            or [p["type"] for p in split] != ["Split", "ByteLevel"] or not split[0]["invert"] or split[0]["behavior"] != "Removed"
            or split[0]["pattern"] != {"Regex": _SPLIT} or split[1]["add_prefix_space"] or split[1]["use_regex"]
            or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        ):
            raise ValueError(f"{path}: not a tokenizer of the kind this module knows")
        vocabulary, letters, end = model["vocab"], byte_letters(), model["end_of_word_suffix"] or ""
        self.inner = [vocabulary.get(c) for c in letters]
        self.last = [vocabulary.get(c + end) for c in letters]
        #: By the left id, then by the right one: the rank of their merge. By rank: the id that it makes.
        self.rank: dict[int, dict[int, int]] = {i: {} for i in vocabulary.values()}
        self.made: list[int] = []
        for k, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[vocabulary[left]][vocabulary[right]] = k
            self.made.append(vocabulary[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in vocabulary.items()} | {i: s for s, i in self.special.items()}
        longest_first = sorted(self.special, key=len, reverse=True)
        self._at_special = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if longest_first else None
        # White space only parts words, whatever it is. Letters first: what the others start with is no letter.
        self._words = regex.compile(r"\p{L}+|'(?:s|t|re|ve|m|ll|d)|\p{N}|[^\s\p{L}\p{N}]+")
        self._unassigned = unassigned()
        self._library = Tokenizer.from_file(path)
        self._known = _Known(self.merged)

    def merged(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word."""
        symbols = [i for i in [*map(self.inner.__getitem__, word[:-1]), self.last[word[-1]]] if i is not None]
        n, rank, made = len(symbols), self.rank, self.made
        if n < 2:
            return tuple(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [r * n + at for at in range(n - 1) if (r := rank[symbols[at]].get(symbols[at + 1])) is not None]
        heapify(queue)
        while queue:
            r, at = divmod(heappop(queue), n)
            left, right_at = symbols[at], after[at]
            if left < 0 or right_at < 0:
                continue
            now = rank[left].get(symbols[right_at])
            if now != r and (now is None or made[now] != made[r]):  # the pair has changed since
                continue
            symbols[at] = new = made[r]
            symbols[right_at] = -1
            after[at] = beyond = after[right_at]
            if beyond >= 0:
                before[beyond] = at
                if (r := rank[new].get(symbols[beyond])) is not None:
                    heappush(queue, r * n + at)
            if (ahead := before[at]) >= 0 and (r := rank[symbols[ahead]].get(new)) is not None:
                heappush(queue, r * n + ahead)
        return tuple([i for i in symbols if i >= 0])

    def _split(self, part: str) -> list[str]:
        if not part.isascii():
            if self._unassigned[np.frombuffer(part.encode("utf-32-le"), np.uint32)].any():
                part = self._library.normalizer.normalize_str(part)
                letters = {c: b for b, c in enumerate(byte_letters())}
                found = self._library.pre_tokenizer.pre_tokenize_str(part)
                return [bytes(letters[c] for c in word).decode() for word, _ in found]
            # Letters are lowered one by one: a last sigma is like any other.
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
        return self._words.findall(part.lower())

    def _pieces(self, text: str, cut: int) -> Iterator[str]:
        first = 0
        while len(text) - first > cut:
            place = text.find(" ", first + cut)
            if place < 0:
                break
            yield text[first:place]
            first = place
        yield text[first:]

    def encode(self, text: str, ids: array, cut: int = CUT) -> None:
        """Adds the ids of ``text`` to ``ids``."""
        of = self._known.__getitem__
        for piece in self._pieces(text, cut):
            for part in self._at_special.split(piece) if self._at_special else [piece]:
                if part in self.special:
                    ids.append(self.special[part])
                else:
                    ids.extend(chain.from_iterable(map(of, self._split(part))))

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.strings.__getitem__, ids))


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def encode(df: DataFrame, path: str, keep: list[str], text: str = "text", out: str = "tokens", cut: int = CUT) -> DataFrame:
    """The columns ``keep`` and the ids of each text, as binary: little-endian unsigned 32-bit integers.

    ``path`` is the place of the tokenizer file, the same on every machine. Special tokens count where a text holds their
    strings; none are added. A missing or empty text gives no ids; equal rows give equal rows, an empty table an empty one.
    Texts of any length are taken whole. Other columns are not read, whatever their names; ``out`` must not be in ``keep``.
    """
    prepare(df.sparkSession)
    source = df.select(*[F.col(c) for c in keep], text_of(text).alias(out))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(path).encode
        for batch in batches:
            packed = []
            for value in batch.column(len(keep)):
                of(value.as_py(), ids := array("I"), cut)
                packed.append(np.frombuffer(ids, np.uint32).astype("<u4").tobytes() if ids else b"")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(packed, pa.binary())], names=[*keep, out])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, keep: list[str], tokens: str = "tokens", out: str = "text") -> DataFrame:
    """The columns ``keep`` and the text of each row's ids (binary as ``encode`` gives them): their strings with a space between.

    Missing or no ids give an empty text; an id without a string raises. ``out`` must not be in ``keep``.
    """
    prepare(df.sparkSession)
    source = df.select(*[F.col(c) for c in keep], F.coalesce(F.col(tokens), F.lit(b"")).alias(out))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = tokenizer(path).decode
        for batch in batches:
            texts = [of(np.frombuffer(x.as_buffer(), "<u4").tolist()) if x.as_buffer().size else "" for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, out])

    return source.mapInArrow(run, schema)


def tokens_by_document(documents: DataFrame, path: str) -> DataFrame:
    """Number of ids, digest of the ids, and digest of the text they decode to, of every document."""
    encoded = encode(documents, path, ["doc_id"]).select(
        "doc_id", (F.octet_length("tokens") / 4).cast("long").alias("n_tokens"), F.sha2("tokens", 256).alias("ids_sha256"), "tokens"
    )
    back = decode(encoded, path, ["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))
