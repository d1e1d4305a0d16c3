"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens score by their log-odds of toxic against other documents. Counts are smoothed along a chain of Dirichlet priors:
the rate of a word is drawn towards that of its longest prefix, this one towards the next shorter, down to the rate of all.
A constant taken off every score makes ordinary text drift downwards, so the maximal scoring segments (found in linear
time) are passages that stand out. How high the best segment of a clean document of n tokens gets follows an extreme-value
law; it turns scores into significance, whose sum over a document's significant passages is calibrated to a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.llm.common import blocks, prepare, stored, text_of
from tidyveil.llm.decontaminate import words_of

#: Counts are kept in this many buckets, by hash of the prefix; a fixed size, so the model is bounded.
BUCKETS = 1 << 20
#: Bytes of the prefixes in the chain before the whole word; how many documents a prior counts for.
PREFIXES, PRIOR = (3, 4, 5, 6, 7, 8), 8.0
#: The most words that a Python worker remembers.
REMEMBERED = 200_000
#: Taken off every token's log-odds.
DRIFT = 2.5
#: A passage counts as significant below this chance of one as high in a clean document of equal length.
CHANCE = 0.01
#: The model is fitted on this many labelled documents at most, picked by hash of their id; fewer are all used. It bounds
#: the table of labels that is broadcast, so no text is shuffled.
MOST_LABELS = 100_000
#: Calibration: bins of a document's evidence.
LOW, HIGH, STEP = -20.0, 120.0, 0.5


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (words x chain) and which of them apply: a prefix has to be shorter than the word."""
    of = xxhash.xxh64_intdigest
    columns = [[of(w[:n], n) for w in words] for n in PREFIXES] + [[of(w, 0) for w in words]]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    applies = np.stack([sizes > n for n in PREFIXES] + [sizes > 0], axis=1)
    return (np.array(columns, np.uint64).T & np.uint64(BUCKETS - 1)).astype(np.int64), applies


@dataclass
class Counts:
    """Documents by bucket: toxic ones and all; and the totals of both."""

    toxic: np.ndarray
    all: np.ndarray
    n_toxic: int
    n_all: int

    def scores(self, words: list[bytes]) -> np.ndarray:
        buckets, applies = features(words)
        base = (self.n_toxic + 0.5) / (self.n_all + 1.0)
        rate = np.full(len(words), base)
        for k in range(buckets.shape[1]):
            b = buckets[:, k]
            rate = np.where(applies[:, k], (self.toxic[b] + PRIOR * rate) / (self.all[b] + PRIOR), rate)
        return np.log(rate / (1 - rate)) - np.log(base / (1 - base)) - DRIFT


class _Scores(dict):
    """Scores of words by a model, kept while there are not too many."""

    def __init__(self, model: Counts) -> None:
        self.model = model

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > REMEMBERED:
            self.clear()
        new = list(set(words).difference(self))
        if new:
            self.update(zip(new, self.model.scores(new).tolist()))
        return np.fromiter(map(self.__getitem__, words), np.float64, len(words))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments as start, end (exclusive) and score, in linear time."""
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    starts = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums = np.add.reduceat(scores, starts).tolist()
    ends = np.append(starts[1:], len(scores)).tolist()
    # A candidate is: first, end, total before it, total after it, the last candidate before it with less before it.
    found: list[tuple[int, int, float, float, int]] = []
    total = 0.0
    for first, end, amount in zip(starts.tolist(), ends, sums):
        if amount <= 0:
            total += amount
            continue
        before, total = total, total + amount
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                found.append((first, end, before, total, j))
                break
            first, before = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after, _ in found]


@dataclass
class Tail:
    """Extreme-value law of the best segment of clean documents: P(above s | n tokens) = 1 - exp(-scale * n * exp(-rate * s))."""

    rate: float
    scale: float

    def evidence(self, score: float, tokens: int) -> float:
        """-log of the expected number of segments as high."""
        return self.rate * score - np.log(self.scale * tokens)


def _measured(batch: pa.RecordBatch, scores: _Scores) -> Iterator[tuple[int, list[tuple[int, int, float]]]]:
    lists = [words_of(x.as_py()) for x in batch.column(1)]
    values, at = scores.of([w for x in lists for w in x]), 0
    for x in lists:
        yield len(x), segments(values[at : at + len(x)])
        at += len(x)


def _count(train: DataFrame) -> tuple[Counts, Counts]:
    """The counts of both folds. At most one row for each bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for batch in blocks(batches):
            if len(known) > REMEMBERED // 4:
                known.clear()
            lists = [set(words_of(x.as_py())) for x in batch.column(1)]
            new = list(set().union(*lists).difference(known))
            if new:
                buckets, applies = features(new)
                known.update((w, b[a]) for w, b, a in zip(new, buckets.astype(np.int32), applies))
            kinds = batch.column(2).to_numpy() * 2 + batch.column(3).to_numpy()  # toxic, fold
            own = [np.unique(np.concatenate([known[w] for w in x])) if x else np.empty(0, np.int64) for x in lists]
            for kind in np.unique(kinds):
                bucket, n = np.unique(np.concatenate([o for o, k in zip(own, kinds) if k == kind]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(np.full(len(n), kind)), pa.array(n)], names=["bucket", "kind", "n"])

    seen = train.select("id", "body", "toxic", "fold").mapInArrow(run, "bucket long, kind long, n long")
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).cast("int").alias(f"k{k}")
    rows = seen.groupBy("bucket").agg(*(of(k) for k in range(4))).toArrow()
    totals = {(r["toxic"], r["fold"]): r["n"] for r in train.groupBy("toxic", "fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = np.zeros((4, BUCKETS), np.float32)
    bucket = rows.column("bucket").to_numpy()
    for k in range(4):
        table[k, bucket] = rows.column(f"k{k}").to_numpy()
    fold = lambda f: Counts(table[2 + f], table[f] + table[2 + f], totals.get((1, f), 0), totals.get((0, f), 0) + totals.get((1, f), 0))
    return fold(0), fold(1)


def _crossed(train: DataFrame, folds: tuple[Counts, Counts]) -> DataFrame:
    """toxic, tokens and segment scores of each training document, by the model of the other fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = [_Scores(folds[1]), _Scores(folds[0])]
        for batch in blocks(batches):
            for fold in (0, 1):
                part = batch.filter(pa.compute.equal(batch.column(3), fold))
                found = list(_measured(part, scores[fold]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), pa.array([n for n, _ in found], pa.int64()), pa.array([[s for _, _, s in x] for _, x in found], pa.list_(pa.float64()))],
                    names=["toxic", "tokens", "scores"],
                )

    return train.select("id", "body", "toxic", "fold").mapInArrow(run, "toxic long, tokens long, scores array<double>")


def _tail(crossed: DataFrame) -> Tail:
    """Moments of the best segments of clean documents. For a Gumbel law the deviation gives the rate, the mean the scale."""
    best = F.coalesce(F.array_max("scores"), F.lit(0.0))
    clean = crossed.filter("toxic = 0 AND tokens > 0").agg(F.avg(best).alias("mean"), F.stddev_pop(best).alias("deviation"), F.avg(F.log("tokens")).alias("length")).first()
    rate = np.pi / np.sqrt(6) / max(clean["deviation"] or 0.0, 0.25)
    return Tail(float(rate), float(np.exp(rate * (clean["mean"] or 0.0) - np.euler_gamma - (clean["length"] or 0.0))))


def _rising(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The closest non-decreasing values: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        pools.append([v, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v2, w2, n2 = pools.pop()
            v1, w1, n1 = pools[-1]
            pools[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(int(n), v) for v, _, n in pools])


@dataclass
class Model:
    counts: Counts
    tail: Tail
    levels: np.ndarray

    def evidence(self, tokens: int, scores: list[float]) -> float:
        """What significant passages add up to; without any, what the best one shows."""
        if not scores:
            return LOW
        each = [self.tail.evidence(s, tokens) for s in scores]
        strong = sum(e for e in each if e > -np.log(CHANCE))
        return float(min(max(strong or max(each), LOW), HIGH))

    def probability(self, evidence: float) -> float:
        """The share of toxic documents at this evidence, with a trace of the evidence itself to keep the order."""
        share = np.interp(evidence, np.arange(LOW, HIGH, STEP) + STEP / 2, self.levels)
        return float(0.999 * share + 0.001 * (evidence - LOW) / (HIGH - LOW))


def _levels(crossed: DataFrame, tail: Tail, base: float) -> np.ndarray:
    """Toxic share by bin of evidence, made to rise. The driver gets one row for each bin."""
    strength = F.transform("scores", lambda s: F.lit(tail.rate) * s - F.log(F.lit(tail.scale) * F.col("tokens")))
    strong = F.aggregate(F.filter(strength, lambda e: e > -np.log(CHANCE)), F.lit(0.0), lambda a, b: a + b)
    evidence = F.when(F.size("scores") == 0, F.lit(LOW)).otherwise(F.when(strong > 0, strong).otherwise(F.array_max(strength)))
    at = F.floor((F.least(F.greatest(evidence, F.lit(LOW)), F.lit(HIGH - STEP / 2)) - LOW) / STEP).cast("int")
    bins = int((HIGH - LOW) / STEP)
    toxic, every = np.zeros(bins), np.zeros(bins)
    for row in crossed.groupBy(at.alias("at")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).collect():
        toxic[row["at"]], every[row["at"]] = row["toxic"], row["n"]
    # A tenth of a document at the base rate keeps empty bins neutral; pooling then gives them their neighbours' share.
    return _rising((toxic + 0.1 * base) / (every + 0.1), every + 1e-3)


def _fold(doc_id: str):
    return F.pmod(F.floor(F.crc32(F.col(doc_id).cast("string").cast("binary")) / 4), F.lit(2)).cast("long")


def train_model(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_LABELS) -> Model:
    """Fit on the labelled rows of ``docs``, ``most`` or so. Two folds of documents score each other for the calibration.

    Labels other than 0 and 1 are ignored; a document with several labels counts as toxic if one says so. Without labels
    all scores are low.
    """
    prepare(docs.sparkSession)
    known = labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__of")).agg(F.max(label).cast("long").alias("toxic"))
    labelled = known.count()
    if labelled > most:
        known = known.filter(F.pmod(F.xxhash64("__of"), F.lit(1 << 20)) < int(most / labelled * (1 << 20)))
    rows = docs.select(F.col(doc_id).alias("id"), text_of(text).cast("binary").alias("body"))
    train = stored(rows.join(F.broadcast(known), F.col("id") == F.col("__of")).select("id", "body", "toxic", _fold("id").alias("fold")), "labelled")
    folds = _count(train)
    crossed = stored(_crossed(train, folds), "crossed")
    both = Counts(*(getattr(folds[0], k) + getattr(folds[1], k) for k in ("toxic", "all", "n_toxic", "n_all")))
    tail = _tail(crossed)
    return Model(both, tail, _levels(crossed, tail, (both.n_toxic + 0.1) / (both.n_all + 1)))


def score_texts(
    docs: DataFrame, model: Model, keep: list[str], text: str = "text", score: str = "score", passages: str = "passages"
) -> DataFrame:
    """The columns ``keep``, the score (0 to 1) of each text, and its significant passages, under the names given.

    Passages are structs of start and end (exclusive), in words, score, and chance: how likely a clean text of this
    length has a passage as high. A missing or empty text has none and the lowest score; equal rows score alike.
    """
    prepare(docs.sparkSession)
    # A text that is kept goes to the task once, not a second time to be read.
    own = text in keep and isinstance(docs.schema[text].dataType, T.StringType)
    source = docs.select(*[F.col(c) for c in keep], *([] if own else [text_of(text).cast("binary").alias("__body")]))
    at = keep.index(text) if own else len(keep)
    one = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = _Scores(model.counts)
        for batch in blocks(batches, at):
            body = pa.compute.fill_null(batch.column(at).cast(pa.binary()), b"")
            pair = pa.RecordBatch.from_arrays([body] * 2, names=["x", "body"])
            values, places = [], []
            for n, found in _measured(pair, scores):
                values.append(model.probability(model.evidence(n, [s for _, _, s in found])))
                chances = [(a, b, s, float(-np.expm1(-np.exp(-model.tail.evidence(s, n))))) for a, b, s in found]
                places.append([dict(zip(("start", "end", "score", "chance"), x)) for x in chances if x[3] < CHANCE])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], pa.array(values, pa.float64()), pa.array(places, pa.list_(one))], names=[*keep, score, passages]
            )

    parts = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()), T.StructField("chance", T.DoubleType())]
    schema = T.StructType([*source.schema.fields[: len(keep)], T.StructField(score, T.DoubleType()), T.StructField(passages, T.ArrayType(T.StructType(parts)))])
    return source.mapInArrow(run, schema)


#: Texts that score this or more are taken as toxic.
THRESHOLD = 0.3


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not taken as toxic."""
    scored = score_texts(docs, model, docs.columns, text, "__score", "__passages")
    return scored.filter(F.col("__score") < THRESHOLD).select(docs.columns)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def toxicity_by_document(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that saw the labels of those not held out."""
    model = train_model(documents.select("doc_id", "text"), labels.filter(~held_out()))
    scored = score_texts(documents, model, ["doc_id"])
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )
