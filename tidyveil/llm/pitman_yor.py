"""Language-model scores by a hierarchical Pitman-Yor model.

Every word is a dish. A restaurant for each context (the word before) seats the words seen there; its tables are customers
of the restaurant of the context's ending, and that one's tables are customers of one restaurant that all share, whose base
is uniform over the known words and one more. Seating is sampled in sweeps, and the predictive probabilities of several
sweeps are averaged.

All state of a word, in whichever contexts, lies in one bucket of words by hash, so a sweep needs nothing but the totals of
restaurants from elsewhere: every bucket sends what it has of each of its restaurants to that one's home, which sums up and
answers. Seating is stored after each sweep, so none is sampled again. Counts are summed within a block of documents before they move. Scoring sends tokens to the bucket of their word;
those in a restaurant that the bucket doesn't know go on to its home; sums come back by document. Words that make up a share
of ``FREQUENT`` or more are looked up in a table of at most 1 / FREQUENT rows that every task gets where they follow one
of the ``CONTEXTS`` commonest contexts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.llm.common import BLOCK_ROWS, blocks, prepare, stored, text_of

#: Commonest contexts that the table of frequent words has a column for; bytes of an ending.
CONTEXTS, ENDING = 256, 3
#: Sweeps of the sampler that only warm up, and those that are averaged.
WARM_UP, SAMPLES = 1, 2
#: Strengths of the contexts' and endings' restaurants and of the parent's. Discounts come from the counts.
STRENGTH, PARENT_STRENGTH = 1.0, 1.0
#: Share of all tokens from which on a word counts as frequent; tokens to a bucket of words.
FREQUENT, BUCKET_TOKENS = 1e-4, 4_000_000
#: Bytes of text whose counts are summed before they move; one more such share for every so many buckets, up to a most; pairs of
#: words and contexts that are looked up at once.
BLOCK, BUCKETS_A_BLOCK, MOST_BLOCKS, LOOKUP = 8 << 20, 128, 4, 1 << 15

_WORD = ~np.uint64(0xFF)
#: A context is its ending in 24 bits, then 40 bits of hash below _ENDING; the ending's own restaurant has _ENDING there.
_REST, _ENDING = np.uint64(40), (1 << 40) - 1


def _hashed(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """56 bits of hash that tell the word, and the context that it makes for the next."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    raw, places = bytes(words.buffers()[2] or b""), ends.tolist()
    whole = np.fromiter(map(xxhash.xxh64_intdigest, [raw[a:b] for a, b in zip(places, places[1:])]), np.uint64, len(words))
    data, sizes, ending = np.frombuffer(raw, np.uint8), np.diff(ends), np.zeros(len(words), np.uint64)
    for k in range(ENDING, 0, -1):
        own = np.full(len(words), ord(" "), np.uint64)  # no word has a blank
        there = sizes >= k
        own[there] = data[ends[1:][there] - k]
        ending = ending << np.uint64(8) | own
    return whole & _WORD, ending << _REST | whole % np.uint64(_ENDING)


class _Codes(dict):
    """Of single words what ``_hashed`` gives; ``contexts`` has the contexts by word."""

    def __init__(self) -> None:
        super().__init__()
        self.contexts: dict[int, int] = {}

    def __missing__(self, word: bytes) -> int:
        code, context = (int(x[0]) for x in _hashed(pa.array([word], pa.binary())))
        self[word], self.contexts[code] = code, context
        return code


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, an empty one after each text's last, and how many each text has, that one included."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(bytes((texts.buffers()[2] or pa.py_buffer(b""))[ends[0] : ends[-1]]).lower(), np.uint8)  # lowers ASCII alone
    ends = ends[1:] - ends[0]
    solid = (data != ord(" ")) & (data - np.uint8(9) > 4)  # below 9 it wraps around
    last = np.ones(len(data), bool)
    last[:-1] = ~solid[1:]
    last[ends[ends > 0] - 1] = True
    last = np.flatnonzero(last & solid)
    before = np.append(0, np.cumsum(solid, dtype=np.int32))  # without the blanks between them words lie end to end
    counts = np.searchsorted(last, ends)
    stops = np.concatenate([[0], np.insert(before[last + 1], counts, before[ends])]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(data[solid])]), np.diff(counts, prepend=0) + 1


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted words and contexts of a block; of every token, the end of each text included: the places of its word
    (upper 32 bits) and of the context it stands in; and its row. The start of a text is the context of the end."""
    words, sizes = _words(texts.cast(pa.binary()))
    found = words.dictionary_encode()
    codes, contexts = _hashed(found.dictionary)
    codes, at = np.unique(codes, return_inverse=True)
    by_code = np.empty_like(codes)
    by_code[at] = contexts
    contexts, rank = np.unique(by_code, return_inverse=True)
    at = at[found.indices.to_numpy()]
    return codes, contexts, at << 32 | rank[np.roll(at, 1)], np.repeat(np.arange(len(texts)), sizes)


def _packed(values: np.ndarray) -> bytes:
    """First the first bytes of all values, then the second ones and so on, compressed."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(values) else b"")


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(kind).reshape(-1)


def _bucket_ends(words: np.ndarray, buckets: int) -> np.ndarray:
    """Where in the sorted words each bucket ends. Buckets are ranges of the hash."""
    return np.searchsorted((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets), side="right")


def _home(rooms: np.ndarray, homes: int) -> np.ndarray:
    """Restaurants of one ending have one home."""
    return (((rooms >> _REST) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(homes)).astype(np.int64)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``wanted`` in the sorted keys, and which are there at all."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    step = 256  # first among every 256th key, which stay in the processor's cache, then all at once in ever smaller steps
    at = np.maximum(np.searchsorted(keys[::step], wanted, side="right") - 1, 0) * step
    while step > 1:
        step //= 2
        at += np.where(keys[np.minimum(at + step, len(keys) - 1)] <= wanted, step, 0)
    at = np.minimum(at, len(keys) - 1)
    return at, keys[at] == wanted


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values start."""
    return np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.empty(0, np.int64)


def _ending_of(contexts: np.ndarray) -> np.ndarray:
    return contexts | np.uint64(_ENDING)


def _seated(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables when ``customers`` of one dish come in one after another; ``fresh`` is the weight of opening a table.

    From 32 customers on they come in groups of a sixteenth of those seated, for which the chance is held.
    """
    out, several = np.ones(len(customers)), np.flatnonzero(customers > 1)  # one customer has one table
    if not len(several):
        return out
    less = -customers[several]
    order = np.argsort(less.astype(np.int16) if less.min() >= -(1 << 15) else less, kind="stable")  # 16 bits are sorted by radix
    less, order = less[order], several[order]
    count, weight, tables, seated = -less, fresh[order], np.ones(len(order)), 1
    while n := int(np.searchsorted(less, -seated, side="left")):
        step = max(1, seated // 16) if seated >= 32 else 1
        chance = weight[:n] / (weight[:n] + seated - discount * tables[:n])
        tables[:n] += rng.random(n) < chance if step == 1 else rng.binomial(np.minimum(step, count[:n] - seated).astype(np.int64), chance)
        seated += step
    out[order] = tables
    return out


#: Of a bucket: tables of each pair, customers and tables of each word by ending and in the parent.
State = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass
class Settings:
    """Of a model: documents' tokens and words, discounts, and the customers and tables of the parent after each sweep."""

    tokens: int
    words: int
    discount: float
    ending_discount: float
    parent_discount: float
    totals: list[tuple[float, float]] = field(default_factory=list)
    seed: int = 7

    def parent(self, customers: np.ndarray | float, tables: np.ndarray | float, k: int) -> np.ndarray:
        total, base = self.totals[k], 1 / (self.words + 1)
        return (customers - self.parent_discount * tables + (PARENT_STRENGTH + self.parent_discount * total[1]) * base) / (PARENT_STRENGTH + total[0])

    def base10(self, count: np.ndarray | float) -> np.ndarray:
        """log10 of the plain smoothed share of a word."""
        return np.log10((count + 0.1) / (self.tokens + 0.1 * (self.words + 1)))


def _child(own: np.ndarray | float, discount: float, totals: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Probability in a restaurant of ``totals`` (customers, tables), ``own`` being the dish's customers there less its discounts."""
    return (own + (STRENGTH + discount * totals[1]) * above) / (STRENGTH + totals[0])


class Bucket:
    """The words of a bucket: their contexts in order with counts, and the seating after each sweep."""

    def __init__(self, number: int, words: np.ndarray, sizes: np.ndarray, counts: np.ndarray, contexts: np.ndarray, at: np.ndarray, homes: int) -> None:
        """``contexts``: once each and in order; ``at``: of each pair, the place of its own there."""
        self.number, self.words, self.counts = number, words, counts.astype(np.float64)
        of = np.repeat(np.arange(len(words)), sizes)
        endings, n = _ending_of(contexts), len(contexts)
        last = np.append(endings[1:] != endings[:-1], True) if n else np.empty(0, bool)
        rank = np.cumsum(last) - last  # of the ending; its restaurant comes right after those of its contexts
        room, ending = np.arange(n) + rank, np.flatnonzero(last) + np.arange(1, last.sum() + 1)
        self.rooms = np.empty(n + len(ending), np.uint64)
        self.rooms[room], self.rooms[ending] = contexts, endings[last]
        rank, first = rank[at], np.ones(len(of), bool)
        first[1:] = (of[1:] != of[:-1]) | (rank[1:] != rank[:-1])
        self.starts = np.flatnonzero(first)
        self.group, self.word = np.cumsum(first) - 1, of[self.starts]  # pair to ending of its word, that to the word
        self.word_starts = np.flatnonzero(np.concatenate([[True], self.word[1:] != self.word[:-1]])) if len(of) else self.starts
        self.room, self.ending = room[at], ending[rank[self.starts]]
        self.pairs, self.groups = of << 32 | self.room, self.word << 32 | self.ending
        home = _home(self.rooms, homes)
        self.by_home, self.home_ends = np.argsort(home.astype(np.uint16) if homes <= 1 << 16 else home, kind="stable"), np.cumsum(np.bincount(home, minlength=homes))
        self.word_counts = self._by_word(self._by_ending(self.counts))

    @staticmethod
    def none(number: int, homes: int) -> Bucket:
        return Bucket(number, *(np.empty(0, t) for t in _PAIRS), homes)

    def at_home(self, home: int) -> np.ndarray:
        return self.by_home[self.home_ends[home - 1] if home else 0 : self.home_ends[home]]

    def _by_ending(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.starts) if len(self.starts) else np.empty(0)

    def _by_word(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.word_starts) if len(self.word_starts) else np.empty(0)

    def _state(self, tables: np.ndarray, ending_tables: np.ndarray, parent_tables: np.ndarray) -> State:
        ending_customers = self._by_ending(tables)
        return tables, ending_customers, ending_tables, self._by_word(ending_tables), parent_tables

    def start(self) -> State:
        """Tables of each pair, customers and tables of each word by ending and in the parent: one table for each dish."""
        return self._state(*(np.ones(len(x)) for x in (self.pairs, self.groups, self.words)))

    def sweep(self, s: Settings, state: State, totals: np.ndarray, k: int) -> State:
        """The state after sweep k, from the one before and its ``totals``: customers and tables of this bucket's restaurants.

        Random numbers depend on bucket and sweep alone, so any task that repeats this gets the same.
        """
        _, ending_customers, ending_tables, customers, parent_tables = state
        rng = np.random.default_rng([s.seed, self.number, k])
        above = s.parent(customers, parent_tables, k)[self.word]
        ending = totals[:, self.ending]
        parent = _child(ending_customers - s.ending_discount * ending_tables, s.ending_discount, ending, above)[self.group]
        tables = _seated(self.counts, (STRENGTH + s.discount * totals[1, self.room]) * parent, s.discount, rng)
        ending_tables = _seated(self._by_ending(tables), (STRENGTH + s.ending_discount * ending[1]) * above, s.ending_discount, rng)
        customers = self._by_word(ending_tables)
        base = (PARENT_STRENGTH + s.parent_discount * s.totals[k][1]) / (s.words + 1)
        return self._state(tables, ending_tables, _seated(customers, np.full(len(customers), base), s.parent_discount, rng))

    @staticmethod
    def packed(state: State) -> list[bytes]:
        """What ``unpacked`` needs."""
        return [_packed(state[k].astype(np.uint64)) for k in (0, 2, 4)]

    def unpacked(self, data: list[bytes]) -> State:
        return self._state(*(_unpacked(x, np.uint64).astype(np.float64) for x in data))

    def sums(self, state: State) -> np.ndarray:
        """Customers and tables that this bucket's words have in each of its restaurants."""
        n = len(self.rooms)
        return np.stack([np.bincount(self.room, a, n) + np.bincount(self.ending, b, n) for a, b in ((self.counts, state[1]), (state[0], state[2]))])

    def averaged(self, s: Settings, states: list[State], totals: list[np.ndarray]) -> list[tuple[np.ndarray, ...]]:
        """By averaged sweep: customers less discounts of pairs and of words by ending, probability of the words in the parent, totals."""
        return [
            (self.counts - s.discount * tables, of_ending - s.ending_discount * ending_tables, s.parent(customers, parent_tables, WARM_UP + k), totals[k])
            for k, (tables, of_ending, ending_tables, customers, parent_tables) in enumerate(states)
        ]

    def log10(
        self, s: Settings, samples: list, words: np.ndarray, of: np.ndarray, contexts: np.ndarray, place: np.ndarray, totals: list | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each token, whose word, known or not, is at ``of`` and its context at ``place``: averaged log10 probability; training
        count of its word; whether this bucket knows both its restaurants; and, of those where it doesn't, by averaged sweep, what
        their home needs instead. ``totals``: of the restaurants of all contexts."""
        at, known = _found(self.words, words)
        (room, has_room), (ending, has_ending) = _found(self.rooms, contexts), _found(self.rooms, _ending_of(contexts))
        here, word = (has_room & has_ending)[place], at[of] << 32
        pair, seen = _found(self.pairs, word | room[place])
        seen = seen & known[of] & has_room[place]
        group, grouped, rest = np.zeros(len(of), np.int64), seen.copy(), np.flatnonzero(~seen)
        group[seen] = self.group[pair[seen]]
        group[rest], there = _found(self.groups, word[rest] | ending[place[rest]])
        grouped[rest] = there & known[of[rest]] & has_ending[place[rest]]
        pick = lambda values, i, there: np.where(there, values[i], 0.0) if len(values) else np.zeros(len(i))
        gone = np.flatnonzero(~here)
        total, more = np.zeros(len(of)), np.empty((2 * SAMPLES, len(gone)), np.float32)
        for k, (own, by_ending, parent, t) in enumerate(samples):
            unknown = s.parent(0.0, 0.0, WARM_UP + k)
            above = (np.where(known, parent[at], unknown) if len(parent) else np.full(len(words), unknown))[of]
            own, by_ending = pick(own, pair, seen), pick(by_ending, group, grouped)
            t_room, t_ending = (totals[k] if totals else (np.stack([pick(t[j], i, there) for j in (0, 1)]) for i, there in ((room, has_room), (ending, has_ending))))
            total += _child(own, s.discount, t_room[:, place], _child(by_ending, s.ending_discount, t_ending[:, place], above))
            more[2 * k], more[2 * k + 1] = by_ending[gone], above[gone]
        return np.log10(total / SAMPLES), pick(self.word_counts, at, known)[of], here, more


@dataclass
class Model:
    """Counts by bucket, stored; totals after each sweep by restaurants' home and by bucket, stored; and what all buckets share."""

    rows: DataFrame
    rounds: list[DataFrame]
    buckets: int
    settings: Settings


def _rows(docs: DataFrame, doc_id: str, text: str, *more: Column) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), text_of(text).cast("binary").alias("body"), *more)


#: Rows on the way to a bucket or, in its place, a home: the model's (kind 0), totals of round k (k from 1 on) and the bucket's
#: own state after it (STATES + k), tokens of a block (TOKENS) and for a home (LOST), then documents of a block (DOCUMENTS) and
#: sums for a block (SUMS).
STATES, TOKENS, LOST, DOCUMENTS, SUMS = 50, 100, 101, 102, 103
_WAY = "kind int, bucket int, block long, a binary, b binary, c binary, d binary, e binary, f binary"
_WAY_NAMES = ["kind", "bucket", "block", "a", "b", "c", "d", "e", "f"]
_WAY_KINDS = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 6]


def _way(rows: list[tuple], ids: pa.Array | None = None, id_type: pa.DataType | None = None) -> pa.RecordBatch:
    """Rows, which may leave their last columns out; the last of them gets the ids."""
    columns = [pa.array([r[k] if k < len(r) else None for r in rows], t) for k, t in enumerate(_WAY_KINDS)]
    if id_type is None:
        return pa.RecordBatch.from_arrays(columns, names=_WAY_NAMES)
    if ids is None:
        own = pa.nulls(len(rows), pa.list_(id_type))
    else:
        own = pa.concat_arrays([pa.nulls(len(rows) - 1, pa.list_(id_type)), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)])
    return pa.RecordBatch.from_arrays([*columns, own], names=[*_WAY_NAMES, "ids"])


def _by_bucket(batches: Iterator[pa.RecordBatch], homes: int, rounds: int) -> Iterator[tuple[Bucket, list[State], list[np.ndarray], tuple | None]]:
    """Buckets with their states and the totals of their restaurants, from rows in order: for each row of another kind, and at
    the end of each bucket."""
    own, states, totals = None, [], []
    for batch in batches:
        for k, (kind, number, block) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
            if own is None or own.number != number:
                if own is not None:
                    yield own, states, totals, None
                own = Bucket(number, *_pairs_of(batch, k), homes) if kind == 0 else Bucket.none(number, homes)
                states, totals = [own.start()] * rounds, [np.zeros((2, len(own.rooms))) for _ in range(rounds)]
            if 0 < kind < STATES:
                at = own.at_home(block)
                for j in (0, 1):
                    totals[kind - 1][j, at] = _unpacked(batch.column(3 + j)[k].as_py(), np.uint64)
            elif STATES < kind < TOKENS:
                states[kind - STATES - 1] = own.unpacked([batch.column(3 + j)[k].as_py() for j in range(3)])
            elif kind >= TOKENS:
                yield own, states, totals, (batch, k)
    if own is not None:
        yield own, states, totals, None


def _blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """The rows in blocks, larger ones where there are many buckets, for each of which a block would have too little."""
    most, kept, size, n = BLOCK * min(MOST_BLOCKS, 1 + buckets // BUCKETS_A_BLOCK), [], 0, 0
    for batch in blocks(batches, most=BLOCK):
        if kept and (size + batch.column(1).nbytes > most or n + batch.num_rows > BLOCK_ROWS):
            yield pa.concat_batches(kept)
            kept, size, n = [], 0, 0
        kept.append(batch)
        size, n = size + batch.column(1).nbytes, n + batch.num_rows
    if kept:
        yield pa.concat_batches(kept)


def _pairs(rows: DataFrame, buckets: int) -> DataFrame:
    """Counts of words in contexts: of each block of texts, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _blocks(batches, buckets):
            words, contexts, key, _ = _tokens(batch.column(1))
            key, n = np.unique(key, return_counts=True)
            yield _way([(0, b, 0, *data) for b, *data, _, _ in _dealt(words, contexts, key, n, buckets)])

    return rows.mapInArrow(run, _WAY)


#: Columns a to e: words, pairs of each, counts of the pairs, contexts once each and in order, places of the pairs' contexts.
_PAIRS = (np.uint64, np.int64, np.uint64, np.uint64, np.uint32)


def _pair_columns(*values: np.ndarray) -> list[bytes]:
    return [_packed(v.astype(t, copy=False)) for v, t in zip(values, _PAIRS)]


def _pairs_of(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, ...]:
    """What such columns hold."""
    return tuple(_unpacked(batch.column(3 + j)[k].as_py(), t) for j, t in enumerate(_PAIRS))


def _dealt(words: np.ndarray, contexts: np.ndarray, key: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple]:
    """Of each bucket that has some of the sorted pairs: its number and columns; its first pair and the one after its last."""
    at, places = key >> 32, key & 0xFFFFFFFF
    of_pairs = np.append(_starts(at), len(key))
    of_words, sizes = words[at[of_pairs[:-1]]], np.diff(of_pairs)
    out, ends = [], _bucket_ends(of_words, buckets).tolist()
    for b, (a, e) in enumerate(zip([0, *ends[:-1]], ends)):
        if e > a:
            i, j = of_pairs[a], of_pairs[e]
            own, at = np.unique(places[i:j], return_inverse=True)
            out.append((b, *_pair_columns(of_words[a:e], sizes[a:e], n[i:j], contexts[own], at), i, j))
    return out


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """The columns of all parts as those of one, each pair once and in order."""
    if len(parts) == 1:
        return parts[0]
    (words, of), (contexts, place) = (np.unique(np.concatenate([p[j] for p in parts]), return_inverse=True) for j in (0, 3))
    at = np.concatenate([p[4] + np.int64(first) for p, first in zip(parts, np.cumsum([0, *(len(p[3]) for p in parts)]))])
    key = np.repeat(of, np.concatenate([p[1] for p in parts])) << 32 | place[at]
    order = np.argsort(key)
    key = key[order]
    starts = _starts(key)
    key, counts = key[starts], np.add.reduceat(np.concatenate([p[2] for p in parts])[order], starts)
    return words, np.bincount(key >> 32, minlength=len(words)), counts, contexts, (key & 0xFFFFFFFF).astype(np.uint32)


_FIGURES = ["tokens", "words", "pairs", "groups", "ones", "twos", "ending_ones", "ending_twos", "parent_ones", "parent_twos"]


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come ordered by bucket. One row for each, with what the settings need of it."""

    def row(number: int, parts: list) -> pa.RecordBatch:
        columns = _merged(parts)
        own, n = Bucket(number, *columns, 1), columns[2]
        _, of_ending, _, of_word, _ = own.start()
        figures = [int(n.sum()), len(own.words), len(n), len(of_ending), *(int((x == k).sum()) for x in (n, of_ending, of_word) for k in (1, 2))]
        return pa.RecordBatch.from_arrays([*_way([(0, number, 0, *_pair_columns(*columns))]).columns, *(pa.array([v], pa.int64()) for v in figures)], names=[*_WAY_NAMES, *_FIGURES])

    number, parts, waiting = -1, [], 0
    for batch in batches:
        for k, b in enumerate(batch.column(1).to_pylist()):
            if b != number and parts:
                yield row(number, parts)
                parts, waiting = [], 0
            number = b
            parts.append(_pairs_of(batch, k))
            waiting += len(parts[-1][2])
            if waiting > 2 * len(parts[0][2]) + 2_000_000:  # don't let equal keys pile up
                parts = [_merged(parts)]
                waiting = len(parts[0][2])
    if parts:
        yield row(number, parts)


def _partitions(buckets: int) -> int:
    """More partitions than buckets, so that hashing seldom puts several into one."""
    return max(8, 2 * buckets)


def _to_buckets(rows: DataFrame, rounds: list[DataFrame], buckets: int) -> DataFrame:
    """The model's rows and the totals and states of these rounds, all rows of a bucket together and in order."""
    for k, r in enumerate(rounds):
        kind = F.when(F.col("kind") == 1, F.lit(k + 1)).otherwise(F.lit(STATES + k + 1)).alias("kind")
        rows = rows.unionByName(r.filter("kind > 0").select(*(kind if c == "kind" else c for c in _WAY_NAMES)), allowMissingColumns=True)
    return rows.repartition(_partitions(buckets), "bucket").sortWithinPartitions("bucket", "kind", "block")


def _round(rows: DataFrame, rounds: list[DataFrame], buckets: int, s: Settings) -> DataFrame:
    """One more sweep (the first time: the start) over all buckets, then totals by home (kind 0) and for each bucket (kind 1).
    States (kind 2) are kept for the next sweep and for scoring; none is sampled again."""
    before = len(rounds)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, states, totals, _ in _by_bucket(batches, buckets, min(before, 1)):
            state = own.sweep(s, states[0], totals[0], before - 1) if before else own.start()
            sums, parent = own.sums(state).astype(np.uint64), np.array([state[3].sum(), state[4].sum()])
            out = [(0, home, own.number, *map(_packed, (own.rooms[at], *sums[:, at]))) for home in range(buckets) if len(at := own.at_home(home))]
            # What the bucket has of the parent goes with its first row.
            out = [(*r, None, (parent if k == 0 else np.zeros(2)).tobytes()) for k, r in enumerate(out)]
            yield _way([*out, (2, own.number, -1, *own.packed(state))] if before else out)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, asked, parent = None, [], np.zeros(2)

        def out() -> pa.RecordBatch:
            rooms, at = np.unique(np.concatenate([r for _, r, _ in asked]), return_inverse=True)
            # Whole numbers below 2**53, so their sums don't depend on the order.
            sums = np.stack([np.bincount(at, np.concatenate([v[j] for *_, v in asked]), len(rooms)) for j in (0, 1)]).astype(np.uint64)
            ends = np.cumsum([len(r) for _, r, _ in asked])
            answers = [(1, b, home, *map(_packed, sums[:, at[e - len(r) : e]])) for (b, r, _), e in zip(asked, ends)]
            return _way([(0, home, 0, *map(_packed, (rooms, *sums)), None, parent.tobytes()), *answers])

        for batch in batches:
            for k, (kind, number, bucket) in enumerate(zip(*(batch.column(j).to_pylist() for j in range(3)))):
                if kind == 2:
                    yield batch.slice(k, 1)
                    continue
                if number != home:
                    if asked:
                        yield out()
                    home, asked, parent = number, [], np.zeros(2)
                rooms, customers, tables = (_unpacked(batch.column(3 + j)[k].as_py(), np.uint64) for j in range(3))
                asked.append((bucket, rooms, (customers, tables)))
                parent += np.frombuffer(batch.column(7)[k].as_py())
        if asked:
            yield out()

    sent = _to_buckets(rows, rounds[-1:], buckets).mapInArrow(sweep, _WAY).repartition(_partitions(buckets), "bucket").sortWithinPartitions("bucket", "block")
    found = stored(sent.mapInArrow(add_up, _WAY), "totals")

    def parents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = np.array([np.frombuffer(v.as_py()) for v in batch.column(0)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["customers", "tables"])

    whole = found.filter("kind = 0").select("e").mapInArrow(parents, "customers double, tables double").agg(F.sum("customers"), F.sum("tables")).first()
    s.totals.append((whole[0] or 0.0, whole[1] or 0.0))
    return found


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Model:
    """Sample the seating of all texts of ``docs``. Without any, every word is as likely as any other."""
    prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    amount = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    buckets = int(max(8, -(-amount // (6 * BUCKET_TOKENS))))  # a word and its blank take about six bytes
    dealt = _pairs(rows, buckets).repartition(_partitions(buckets), "bucket").sortWithinPartitions("bucket")
    found = stored(dealt.mapInArrow(_summed, ", ".join([_WAY, *(f"{c} long" for c in _FIGURES)])), "counts")
    sums = found.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _FIGURES)).first()
    share = lambda kind: min(max(sums[f"{kind}ones"] / (sums[f"{kind}ones"] + 2 * sums[f"{kind}twos"]), 0.05), 0.95) if sums[f"{kind}ones"] else 0.05
    s = Settings(sums["tokens"], sums["words"], share(""), share("ending_"), share("parent_"))
    found, rounds = found.select(*_WAY_NAMES), []
    for _ in range(WARM_UP + SAMPLES):
        rounds.append(_round(found, rounds, buckets, s))
    return Model(found, rounds, buckets, s)


def _frequent(model: Model) -> np.ndarray:
    """Codes of the words that make up a share of FREQUENT of all tokens learnt, sorted. At most 1 / FREQUENT codes reach the driver."""
    least = FREQUENT * model.settings.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(batch.column(j) for j in range(3))):
                words, sizes, counts = (_unpacked(x.as_py(), t) for x, t in zip(row, (np.uint64, np.int64, np.int64)))
                often = np.add.reduceat(counts, np.cumsum(sizes) - sizes) >= least
                yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64))], names=["word"])

    often = model.rows.select("a", "b", "c").mapInArrow(run, "word long").toArrow()
    return np.sort(often.column("word").to_numpy().view(np.uint64))


def _commonest(model: Model) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The contexts with the most customers, CONTEXTS of them at most, sorted; by averaged sweep, totals of their restaurants
    and of those of their endings."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0), batch.column(1)):
                rooms, n = _unpacked(a.as_py(), np.uint64), _unpacked(b.as_py(), np.int64)
                own = np.flatnonzero(_ending_of(rooms) != rooms)
                top = own[np.lexsort((rooms[own], -n[own]))[:CONTEXTS]]
                yield pa.RecordBatch.from_arrays([pa.array(rooms[top].view(np.int64)), pa.array(n[top])], names=["room", "n"])

    top = model.rounds[0].filter("kind = 0").select("a", "b").mapInArrow(most, "room long, n long")
    contexts = np.sort(top.orderBy(F.desc("n"), "room").limit(CONTEXTS).toArrow().column("room").to_numpy().view(np.uint64))
    wanted, out = np.unique(np.concatenate([contexts, _ending_of(contexts)])), []

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rooms, customers, tables = (_unpacked(batch.column(j)[k].as_py(), np.uint64).astype(np.int64 if j else np.uint64) for j in range(3))
                at, there = _found(rooms, wanted)
                values = [np.flatnonzero(there), customers[at[there]], tables[at[there]]]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values], names=["at", "customers", "tables"])

    for found in model.rounds[WARM_UP:]:
        totals = np.zeros((2, len(wanted)))
        for at, *values in found.filter("kind = 0").select("a", "b", "c").mapInArrow(pick, "at long, customers long, tables long").collect():
            totals[:, at] = values
        out.append((totals[:, np.searchsorted(wanted, contexts)], totals[:, np.searchsorted(wanted, _ending_of(contexts))]))
    return contexts, out


def _lookup(model: Model, words: np.ndarray, commonest: tuple | None = None) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of ``words`` (sorted) in each of the commonest contexts, and their training counts: as many rows as
    words. Where there are fewer than CONTEXTS, the last columns are those of a context never seen."""
    s, buckets = model.settings, model.buckets
    contexts, totals = commonest or _commonest(model)
    more = CONTEXTS - len(contexts)
    every = np.append(contexts, np.full(more, ~np.uint64(0)))
    totals = [tuple(np.pad(t, [(0, 0), (0, more)]) for t in both) for both in totals]
    ends = _bucket_ends(words, buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, states, known, _ in _by_bucket(batches, buckets, SAMPLES):
            first, last = (ends[own.number - 1] if own.number else 0), ends[own.number]
            if (n := last - first) > 0:
                values, counts, *_ = own.log10(s, own.averaged(s, states, known), words[first:last], np.repeat(np.arange(n), CONTEXTS), every, np.tile(np.arange(CONTEXTS), n), totals)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, last), pa.int32()), pa.array([v.astype(np.float32).tobytes() for v in values.reshape(-1, CONTEXTS)], pa.binary()), pa.array(counts[::CONTEXTS])],
                    names=["at", "values", "n"],
                )

    # Words of buckets without a row were never seen.
    none = Bucket.none(0, 1)
    samples = [(np.empty(0), np.empty(0), np.empty(0), np.empty((2, 0)))] * SAMPLES
    unseen = none.log10(s, samples, np.zeros(1, np.uint64), np.zeros(CONTEXTS, np.int64), every, np.arange(CONTEXTS), totals)[0]
    table, counts = np.tile(unseen.astype(np.float32), (len(words), 1)), np.zeros(len(words))
    if not len(words):
        return table, counts
    got = _to_buckets(model.rows, model.rounds[WARM_UP:], buckets).mapInArrow(run, "at int, values binary, n double").toArrow()
    for at, values, n in zip(*(got.column(k) for k in range(3))):
        table[at.as_py()], counts[at.as_py()] = np.frombuffer(values.as_buffer(), np.float32), n.as_py()
    return table, counts


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, n_tokens, n_known, base_score and score of every row.

    Tokens are the words, A-Z lowered, and one end. score is the log10 probability that the model gives the text, so its
    perplexity is 10 ** (-score / n_tokens); base_score that of smoothed shares of words; n_known counts the tokens seen in
    training. Missing and empty texts are an end alone; repeated rows score alike; an empty table gives no rows. Other
    columns are not read.
    """
    prepare(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    frequent, commonest = _frequent(model), _commonest(model)
    columns = commonest[0]
    table, table_counts = _lookup(model, frequent, commonest)
    s, buckets = model.settings, model.buckets
    table_base = s.base10(table_counts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in _blocks(batches, buckets):
            words, contexts, key, row = _tokens(batch.column(1))
            n, (at, often), (column, common) = batch.num_rows, _found(frequent, words), _found(columns, contexts)
            local = often[key >> 32] & common[key & 0xFFFFFFFF]
            of, i, j = row[local], at[key[local] >> 32], column[key[local] & 0xFFFFFFFF]
            sums = np.stack([np.bincount(of, table[i, j].astype(np.float64), n), np.bincount(of, table_base[i], n), np.bincount(of, table_counts[i] > 0, n)])
            rest = np.flatnonzero(~local)
            rest = rest[np.argsort(key[rest])]
            pairs = key[rest]
            ends = np.append(_starts(pairs), len(rest))
            pairs, times, of = pairs[ends[:-1]], np.diff(ends), row[rest].astype(np.uint16)
            out = [(TOKENS, b, number, *data, _packed(of[ends[i] : ends[j]])) for b, *data, i, j in _dealt(words, contexts, pairs, times, buckets)]
            out.append((DOCUMENTS, number % buckets, number, sums.tobytes(), np.bincount(row, minlength=n).astype(np.int64).tobytes()))
            yield _way(out, batch.column(0), batch.column(0).type)
            number += 1

    id_type = rows.schema["id"].dataType
    schema = T.StructType([*T.StructType.fromDDL(_WAY).fields, T.StructField("ids", T.ArrayType(id_type))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, asked, pairs, lost = None, [], 0, []

        def away(number: int, kind: pa.DataType) -> pa.RecordBatch:
            """Tokens in restaurants that the bucket doesn't know, by home."""
            contexts, of, block, more = (np.concatenate(x, axis=-1) for x in zip(*lost))
            home = _home(contexts, buckets)
            order = np.argsort(home, kind="stable")
            homes, starts = np.unique(home[order], return_index=True)
            parts = zip(homes.tolist(), np.split(order, starts[1:]))
            return _way([(LOST, h, number, *(_packed(x[at]) for x in (contexts, of, block)), _packed(more[:, at].reshape(-1))) for h, at in parts], None, kind)

        def answers(own: Bucket, kind: pa.DataType) -> pa.RecordBatch:
            """Sums for the blocks that asked. Tokens for homes are put aside."""
            words, sizes, _, contexts, places = zip(*(x for _, x, _ in asked))
            of = np.repeat(np.arange(sum(map(len, words))), np.concatenate(sizes))
            place = np.concatenate([p + np.int64(first) for p, first in zip(places, np.cumsum([0, *map(len, contexts)]))])
            contexts = np.concatenate(contexts)
            value, count, here, more = own.log10(s, samples, np.concatenate(words), of, contexts, place)
            before, own_value, base, first, out = np.cumsum(~here) - 1, np.where(here, value, 0.0), s.base10(count), 0, []
            for block, (_, _, times, *_), of in asked:
                pair, first = first + np.repeat(np.arange(len(times)), times.astype(np.int64)), first + len(times)
                rows_of, at = np.unique(of, return_inverse=True)
                sums = [np.bincount(at, x) for x in (own_value[pair], base[pair], count[pair] > 0)]
                out.append((SUMS, block % buckets, block, *(_packed(x) for x in (rows_of, sums[0].astype(np.float32), sums[1], sums[2].astype(np.uint32)))))
                gone = np.flatnonzero(~here[pair])
                if len(gone):
                    pair = pair[gone]
                    lost.append((contexts[place[pair]], of[gone], np.full(len(pair), block), more[:, before[pair]]))
            return _way(out, None, kind)

        for own, states, totals, row in _by_bucket(batches, buckets, SAMPLES):
            if row is not None:
                batch, k = row
                if batch.column(0)[k].as_py() == DOCUMENTS:
                    yield batch.slice(k, 1)
                    continue
                samples, kind_of_ids = samples or own.averaged(s, states, totals), batch.column(9).type.value_type
                asked.append((batch.column(2)[k].as_py(), _pairs_of(batch, k), _unpacked(batch.column(8)[k].as_py(), np.uint16)))
                pairs += len(asked[-1][1][2])
                if pairs < LOOKUP:
                    continue
            if asked:
                yield answers(own, kind_of_ids)
                asked, pairs = [], 0
            if lost and (row is None or sum(len(x[0]) for x in lost) > 1_000_000):
                yield away(own.number, kind_of_ids)
                lost = []
            if row is None:
                samples = None

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What the buckets couldn't look up, at the homes of the restaurants."""
        home, totals = None, {}
        for batch in batches:
            for k, (kind, number) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if kind in (DOCUMENTS, SUMS):
                    yield batch.slice(k, 1)
                    continue
                data = [batch.column(3 + j)[k].as_py() for j in range(4)]
                if number != home:
                    home, totals = number, {}
                if kind < TOKENS:
                    totals[kind] = [_unpacked(x, np.uint64) for x in data[:3]]
                    continue
                contexts, of, block, more = (_unpacked(x, t) for x, t in zip(data, (np.uint64, np.uint16, np.int64, np.float32)))
                more, total = more.astype(np.float64).reshape(2 * SAMPLES, -1), np.zeros(len(contexts))
                for j in range(SAMPLES):
                    rooms, *values = totals.get(j + 1, [np.empty(0, np.uint64)] * 3)
                    both = []
                    for wanted in (contexts, _ending_of(contexts)):
                        at, there = _found(rooms, wanted)
                        both.append(np.stack([np.where(there, v[at].astype(np.float64), 0.0) if len(v) else np.zeros(len(at)) for v in values]))
                    total += _child(0.0, s.discount, both[0], _child(more[2 * j], s.ending_discount, both[1], more[2 * j + 1]))
                value, order = np.log10(total / SAMPLES), np.argsort(block, kind="stable")
                numbers, starts = np.unique(block[order], return_index=True)
                out = []
                for b, at in zip(numbers.tolist(), np.split(order, starts[1:])):
                    rows_of, place = np.unique(of[at], return_inverse=True)
                    out.append((SUMS, home, b, _packed(rows_of), _packed(np.bincount(place, value[at]).astype(np.float32))))
                yield _way(out, None, batch.column(9).type.value_type)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, sums, n = None, None, None, None

        def out() -> pa.RecordBatch:
            columns = [pa.array(n), pa.array(sums[2].astype(np.int64)), pa.array(sums[1]), pa.array(sums[0])]
            return pa.RecordBatch.from_arrays([ids, *columns], names=["id", "n_tokens", "n_known", "base_score", "score"])

        for batch in batches:
            for k, (kind, block) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
                if block != at:
                    if ids is not None:
                        yield out()
                    at, ids, n = block, batch.column(9)[k].values, np.frombuffer(batch.column(4)[k].as_py(), np.int64)
                    sums = np.frombuffer(batch.column(3)[k].as_py(), np.float64).reshape(3, -1).copy()
                    continue
                of, *values = (batch.column(3 + j)[k].as_py() for j in range(4))
                of = _unpacked(of, np.uint16)
                for j, (v, t) in enumerate(zip(values, (np.float32, np.float64, np.uint32))):
                    if v is not None:  # homes add to the score alone
                        sums[j, of] += _unpacked(v, t)
        if ids is not None:
            yield out()

    sent = rows.mapInArrow(send, schema)
    found = _to_buckets(sent.unionByName(model.rows, allowMissingColumns=True), model.rounds[WARM_UP:], buckets).mapInArrow(look_up, schema)
    for k, r in enumerate(model.rounds[WARM_UP:]):
        found = found.unionByName(r.filter("kind = 0").withColumn("kind", F.lit(k + 1)).drop("e", "f"), allowMissingColumns=True)
    back = found.repartition(_partitions(buckets), "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(settle, schema)
    result = T.StructType([rows.schema["id"], *T.StructType.fromDDL("n_tokens long, n_known long, base_score double, score double").fields])
    return back.repartition("block").sortWithinPartitions("block", "kind").mapInArrow(add_up, result)


def _held_out(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def scores_by_document(documents: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those not held out."""
    model = train(documents.select("doc_id", "text").filter(~_held_out("doc_id")))
    found = score(documents.select("doc_id", "text"), model)
    return found.select(
        F.col("id").alias("doc_id"), _held_out("id").alias("held_out"), "n_tokens", "n_known",
        F.lit(model.settings.tokens).cast("long").alias("train_tokens"), "base_score", "score",
    )
