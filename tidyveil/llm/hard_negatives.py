"""Hard negatives by maximum inner product search in cover trees.

One more component makes all candidates equally long (the norm augmentation), so that the inner product with an anchor
falls with the distance from it, and the covering radius of a tree's node bounds the scores of all below it from both
sides. The cells of a bounded sample are the tops of the tree; each cell is cut into blocks of bounded size, which have
a tree each. Anchors visit their own cell first, then every other that what they have found does not exclude.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidyveil.llm.common import prepare, stored

#: Points of one block, anchors that meet a block at once, points of a leaf, children of a node.
BLOCK, TOGETHER, LEAF, FAN = 4096, 512, 64, 16
#: Leaves of a block that a query looks at before it asks whether others can better what it has.
FIRST = 8
#: The cells are found among so many points at most, or so many bytes of them. Every point is then put into its cell.
SAMPLE, SAMPLE_BYTES, CELLS = 32_768, 64 << 20, 2_048
#: By which factor covering radii shrink from level to level, where the number of children allows.
BASE = 2.0
#: Scores stay below this, so that sums of whole numbers are exact as doubles.
EXACT = float(1 << 53)


def scaled(vector: str, factor: int = 256) -> Column:
    """The components of ``vector`` as whole numbers: floor(factor * x), x as double."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: F.floor(x * F.lit(float(factor))))


def _is_sound(vector: str) -> Column:
    of = F.col(vector).cast("array<double>")
    return F.col(vector).isNotNull() & ~F.exists(of, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


# The tree, with numpy alone


@dataclass
class Tree:
    """Nodes level by level. A node covers all points of ``first`` to ``last`` if it is a leaf, else those of its children."""

    center: np.ndarray  # the point of each node
    radius: np.ndarray  # no point below it is further away
    first: np.ndarray  # of the points, or of the children
    last: np.ndarray
    leaf: np.ndarray
    order: np.ndarray  # the points, so that those of a leaf stand together


def _distances(points: np.ndarray, center: int, rows: np.ndarray) -> np.ndarray:
    return np.sqrt(((points[rows] - points[center]) ** 2).sum(axis=1))


def _net(points: np.ndarray, rows: np.ndarray, center: int, away: np.ndarray, most: int) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centers, more than the parent's radius over BASE apart, until they cover ``rows`` or are ``most``; the nearest of each row."""
    reach = away.max() / BASE
    centers, nearest, least = [center], np.zeros(len(rows), np.int64), away.copy()
    while len(centers) < most and len(open_ := np.flatnonzero(least > reach)):
        centers.append(int(rows[open_[0]]))
        now = _distances(points, centers[-1], rows)
        closer = now < least
        nearest[closer], least[closer] = len(centers) - 1, now[closer]
    return centers, nearest, least


def cover_tree(points: np.ndarray, leaf: int = LEAF, fan: int = FAN) -> Tree:
    center, radius, first, last, is_leaf, order, placed = [0], [0.0], [0], [0], [True], [], 0
    todo = [(0, np.arange(len(points)), _distances(points, 0, np.arange(len(points))))] if len(points) else []
    for node, rows, away in todo:  # grows while it is read
        radius[node] = float(away.max())
        if len(rows) <= leaf or radius[node] == 0:
            order.append(rows)
            first[node], placed = placed, placed + len(rows)
            last[node] = placed
            continue
        centers, nearest, least = _net(points, rows, center[node], away, fan)
        is_leaf[node], first[node], last[node] = False, len(center), len(center) + len(centers)
        for k, c in enumerate(centers):
            todo.append((len(center), rows[nearest == k], least[nearest == k]))
            for column, value in ((center, c), (radius, 0.0), (first, 0), (last, 0), (is_leaf, True)):
                column.append(value)
    return Tree(*map(np.array, (center, radius, first, last, is_leaf)), np.concatenate(order) if order else np.empty(0, np.int64))


def augmented(points: np.ndarray, longest: float) -> np.ndarray:
    """``points`` with the component that gives each the squared length ``longest``."""
    return np.column_stack([points, np.sqrt(np.maximum(longest - (points**2).sum(axis=1), 0))])


def bounds(products: np.ndarray, squared: np.ndarray, radius: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries with points within ``radius`` of centers.

    ``products`` of queries (rows) and centers, ``squared`` lengths of queries. Rounding is allowed for.
    """
    whole = (squared + longest)[:, None]
    away, slack = np.sqrt(np.maximum(whole - 2 * products, 0)), 1e-9 * whole + 1e-6
    return (whole - (away + radius) ** 2) / 2 - slack, (whole - np.maximum(away - radius, 0) ** 2) / 2 + slack


class Block:
    """Some points with their labels, the ids of each, and their tree."""

    def __init__(self, points: np.ndarray, labels: np.ndarray, ids: list[np.ndarray], longest: float) -> None:
        self.longest = longest
        self.tree = tree = cover_tree(augmented(points, longest))
        self.centers = points[tree.center] if len(points) else points
        self.points, self.labels, self.ids = points[tree.order], labels[tree.order], [ids[i] for i in tree.order]

    def pack(self) -> bytes:
        t, file = self.tree, io.BytesIO()
        small = np.int32 if not self.points.size or np.abs(self.points).max() < 1 << 31 else np.int64
        np.savez(
            file, points=self.points.astype(small), labels=self.labels, ids=np.concatenate(self.ids), ends=np.cumsum(list(map(len, self.ids))),
            longest=self.longest, centers=self.centers.astype(small), radius=t.radius, first=t.first, last=t.last, leaf=t.leaf, center=t.center,
        )
        return file.getvalue()

    @classmethod
    def unpack(cls, packed: bytes) -> Block:
        x, self = np.load(io.BytesIO(packed)), cls.__new__(cls)
        self.longest, self.points, self.labels, self.centers = float(x["longest"]), x["points"].astype(float), x["labels"], x["centers"].astype(float)
        self.ids = np.split(x["ids"], x["ends"][:-1])
        self.tree = Tree(x["center"], x["radius"], x["first"], x["last"], x["leaf"], np.empty(0, np.int64))
        return self

    def search(self, vectors: np.ndarray, labels: np.ndarray, least: np.ndarray, greatest: np.ndarray, most: int, same: bool) -> np.ndarray:
        """Rows of query, window, score and id: the ``most`` best in each window of each query, ties by the smaller id.

        ``least`` and ``greatest`` hold the scores between which the windows lie, a row for each query; ``same`` asks for
        points of the query's label, else for those of others. All queries go down the tree together, level by level. Of
        the leaves that a query reaches, the best FIRST are verified, and the others where they can still better the
        worst that is kept.
        """
        floor, squared = least.astype(float), (vectors**2).sum(axis=1)
        nodes, alive, leaves, reach = np.array([0]), np.ones((len(vectors), 1), bool), [], []
        while len(nodes):
            low, high = bounds(vectors @ self.centers[nodes].T, squared, self.tree.radius[nodes], self.longest)
            alive &= _may_hold(low, high, floor, greatest)
            is_leaf = self.tree.leaf[nodes]
            for k in np.flatnonzero(is_leaf & alive.any(axis=0)):
                leaves.append(nodes[k])
                reach.append((alive[:, k], low[:, k], high[:, k]))
            inner = np.flatnonzero(~is_leaf & alive.any(axis=0))
            first, last = self.tree.first[nodes[inner]], self.tree.last[nodes[inner]]
            nodes = np.concatenate([np.arange(a, b) for a, b in zip(first, last)]) if len(inner) else inner
            alive = np.repeat(alive[:, inner], last - first, axis=1)
        if not leaves:
            return np.empty((0, 4), np.int64)
        alive, low, high = (np.stack(x, axis=1) for x in zip(*reach))
        sizes = self.tree.last[leaves] - self.tree.first[leaves]
        points = np.concatenate([np.arange(self.tree.first[n], self.tree.last[n]) for n in leaves])
        ends = np.cumsum(sizes)
        scores, fits = np.full((len(vectors), len(points)), -np.inf), (self.labels[points] == labels[:, None]) == same

        def verify(wanted: np.ndarray) -> None:
            for k in np.flatnonzero(wanted.any(axis=0)):
                rows, part = np.flatnonzero(wanted[:, k]), slice(ends[k] - sizes[k], ends[k])
                exact = vectors[rows] @ self.points[points[part]].T
                scores[rows, part] = np.where(fits[rows, part], exact, -np.inf)

        bound = np.where(alive, high, -np.inf)
        best = np.zeros_like(alive)
        np.put_along_axis(best, np.argpartition(-bound, min(FIRST, len(leaves)) - 1, axis=1)[:, :FIRST], True, axis=1)
        verify(best & alive)
        if scores.shape[1] >= most:
            for w in range(floor.shape[1]):
                inside = np.where(scores <= greatest[:, w, None], scores, -np.inf)
                floor[:, w] = np.maximum(floor[:, w], np.partition(inside, -most, axis=1)[:, -most])
        verify(alive & ~best & _may_hold(low, high, floor, greatest))
        found = [np.empty((0, 4), np.int64)]
        for w in range(floor.shape[1]):
            q, at = np.nonzero((scores >= floor[:, w, None]) & (scores <= greatest[:, w, None]))
            ids = [self.ids[i][:most] for i in points[at]]
            times = np.array(list(map(len, ids)), np.int64)
            q, score, ids = np.repeat(q, times), np.repeat(scores[q, at], times).astype(np.int64), np.concatenate([np.empty(0, np.int64), *ids])
            order = np.lexsort((ids, -score, q))
            q, score, ids = q[order], score[order], ids[order]
            nth = np.arange(len(q)) - np.searchsorted(q, q)
            found.append(np.column_stack([q, np.full(len(q), w), score, ids])[nth < most])
        return np.concatenate(found)


def _may_hold(low: np.ndarray, high: np.ndarray, floor: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Whether nodes (columns) can hold something for any of the windows of queries (rows)."""
    may = np.zeros(low.shape, bool)
    for w in range(floor.shape[1]):
        may |= (high >= floor[:, w, None]) & (low <= top[:, w, None])
    return may


# The index: every point in a block of its cell


@dataclass
class Index:
    blocks: DataFrame  # cell, block, packed
    cells: DataFrame  # cell, blocks: a row for each of at most CELLS cells
    centers: np.ndarray
    radius: np.ndarray
    longest: float


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().astype(float).reshape(len(column), width)


def build(points: DataFrame, width: int, longest: float, count: int) -> Index:
    """``points`` has v (array of ``width`` bigint), label and ids; equal v and label stand in one row."""
    spark = points.sparkSession
    sample = points.select("v").orderBy(F.xxhash64("v")).limit(max(1, min(SAMPLE, SAMPLE_BYTES // (8 * width))))
    seen = np.array([r[0] for r in sample.collect()], float).reshape(-1, width)
    wanted = max(1, min(CELLS, -(-count // BLOCK)))
    around = augmented(seen, longest)
    rows = np.arange(len(seen))
    chosen = _net(around, rows, 0, _distances(around, 0, rows), wanted)[0] if len(seen) else []
    centers = seen[chosen].reshape(-1, width)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(0), width)
            cell, away = _nearest(augmented(vectors, longest), augmented(centers, longest))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(away)], names=["v", "label", "ids", "cell", "away"])

    source = points.select("v", "label", "ids")
    dealt = stored(source.mapInArrow(assign, T.StructType([*source.schema.fields, *T._parse_datatype_string("cell int, away double").fields])), "cells")
    sizes = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")).collect()  # CELLS rows at most
    radius = np.zeros(len(centers))
    for r in sizes:
        radius[r["cell"]] = r["radius"]
    cells = spark.createDataFrame([(r["cell"], -(-r["n"] // BLOCK)) for r in sizes], "cell int, blocks int")

    def pack(key: tuple, group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        vectors, ids = _matrix(group.column("v").chunk(0), width), [np.array(x, np.int64) for x in group.column("ids").to_pylist()]
        packed = Block(vectors, group.column("label").to_numpy(), ids, longest).pack()
        return pa.table({"cell": [key[0].as_py()], "block": [key[1].as_py()], "packed": [packed]}, schema=pa.schema([("cell", pa.int32()), ("block", pa.int32()), ("packed", pa.binary())]))

    # Cells have any size; which block of its cell a point is in goes by hash, so that blocks have about BLOCK points.
    block = F.pmod(F.xxhash64("v", "label"), F.col("blocks").cast("long")).cast("int").alias("block")
    split = dealt.join(F.broadcast(cells), "cell").select("cell", block, "v", "label", "ids")
    return Index(stored(split.groupBy("cell", "block").applyInArrow(pack, "cell int, block int, packed binary"), "index"), cells, centers, radius, longest)


def _nearest(points: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    squares = (points**2).sum(axis=1)[:, None] + (centers**2).sum(axis=1) - 2 * points @ centers.T
    cell = squares.argmin(axis=1)
    away = np.sqrt(((points - centers[cell]) ** 2).sum(axis=1))
    return cell, away * (1 + 1e-12) + 1e-9


# The search


def _visits(queries: DataFrame, index: Index, width: int, slots: int, home: bool) -> DataFrame:
    """cell and query for each cell a query has to visit: its own (``home``), or the others that may hold something for it."""
    centers, radius, longest = index.centers, index.radius, index.longest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("v"), width)
            own = _nearest(augmented(vectors, longest), augmented(centers, longest))[0]
            if home:
                rows, cells = np.arange(len(vectors)), own
            else:
                low, high = bounds(vectors @ centers.T, (vectors**2).sum(axis=1), radius, longest)
                visit = _may_hold(low, high, _windows(batch.column("least"), 1), _windows(batch.column("greatest"), -1))
                visit[np.arange(len(own)), own] = False
                rows, cells = np.nonzero(visit)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *taken.columns], names=["cell", *batch.schema.names])

    schema = T.StructType([T.StructField("cell", T.IntegerType()), *queries.schema.fields])
    return queries.mapInArrow(run, schema).withColumn("slot", F.pmod(F.xxhash64("q"), F.lit(slots).cast("long")).cast("int"))


def _windows(column: pa.Array, beyond: int) -> np.ndarray:
    """One row for each list; missing windows are put where no score is, at ``beyond`` times infinity."""
    ends, values = column.value_lengths().to_numpy(), column.flatten().to_numpy().astype(float)
    table = np.full((len(ends), max(ends.max(initial=0), 1)), beyond * np.inf)
    row = np.repeat(np.arange(len(ends)), ends)
    table[row, np.arange(len(row)) - np.repeat(np.cumsum(ends) - ends, ends)] = values
    return table


@lru_cache(maxsize=1)
def _unpacked(packed: bytes) -> Block:
    return Block.unpack(packed)


def _met(visits: DataFrame, index: Index, width: int, most: int, same: bool) -> DataFrame:
    """q, w, score, id of what each visiting query finds in each block of the cell."""
    # A slot holds about TOGETHER queries, whatever their number.
    together = visits.groupBy("cell", "slot").agg(F.collect_list(F.struct("q", "v", "label", "least", "greatest")).alias("queries"))
    spread = together.join(F.broadcast(index.cells), "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed, queries in zip(batch.column("packed"), batch.column("queries")):
                q, v, label, least, greatest = queries.values.flatten()
                block = _unpacked(packed.as_py())
                columns = block.search(_matrix(v, width), label.to_numpy(), _windows(least, 1), _windows(greatest, -1), most, same)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q.to_numpy()[columns[:, 0]]), pa.array(columns[:, 1], pa.int32()), pa.array(columns[:, 2]), pa.array(columns[:, 3])],
                    names=["q", "w", "score", "id"],
                )

    return spread.join(index.blocks, ["cell", "block"]).select("queries", "packed").mapInArrow(run, "q long, w int, score long, id long")


def _best(found: DataFrame, most: int) -> DataFrame:
    order = Window.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def search(queries: DataFrame, index: Index, width: int, count: int, most: int, same: bool) -> DataFrame:
    """q, w, score, id and rank of the ``most`` best for each window of each query.

    ``queries`` has q, v, label, and least and greatest, the scores between which each window lies; there are ``count``.
    """
    slots = max(1, -(-count // TOGETHER))
    near = stored(_best(_met(_visits(queries, index, width, slots, True), index, width, most, same), most), "near")
    # Where a window is full, only what scores at least as much as its last matters from here on.
    worst = near.filter(F.col("rank") == most).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("worst"))
    raised = F.transform("least", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("worst", w), x)))
    left = queries.join(worst, "q", "left").select("q", "v", "label", F.when(F.col("worst").isNull(), F.col("least")).otherwise(raised).alias("least"), "greatest")
    far = _met(_visits(left, index, width, slots, False), index, width, most, same)
    return _best(near.select("q", "w", "score", "id").unionByName(far), most)


def _hundredth(x: Column) -> Column:
    """floor(x / 100), in whole numbers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100).cast("long")), F.lit(100).cast("long"))


def hard_negatives(
    df: DataFrame, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
    positives: int = 5, negatives: int = 3, at_least: int = 50, at_most: int = 95,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the rows where ``is_anchor`` holds.

    An anchor's positives are its best other rows of the same label; for each, the best rows of other labels whose score is
    between ``at_least`` and ``at_most`` percent of the positive's are its negatives. The score is the inner product of
    ``vector``, whole numbers; ties go to the smaller id. Rows with a missing id, label or vector, or a missing or infinite
    component or NaN, take no part. Rows that agree in id, vector and label count once; rows of an equal id are no "other"
    row. Shorter vectors have zeros at their end. Components so large that scores are not exact raise. No rows give none;
    other columns are not read. Of rows with equal vector and label only the least ids can be among the best, so no more are
    kept in the index: the result is that of all.
    """
    prepare(df.sparkSession)
    most = positives + 1  # one of the best of an anchor may be itself
    taken = df.withColumn("__anchor", F.coalesce(is_anchor, F.lit(False))).select(
        F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("raw"), F.col(label).cast("long").alias("label"), "__anchor"
    )
    sound = taken.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _is_sound("raw"))
    length = F.aggregate("raw", F.lit(0.0), lambda s, x: s + x * x)
    facts = sound.agg(F.max(F.size("raw")), F.max(length), F.count(F.lit(1))).first()
    width, longest = max(1, facts[0] or 0), float(facts[1] or 0)
    if longest >= EXACT / 4:
        raise ValueError("components are too large for exact scores")
    padded = F.concat(F.col("raw").cast("array<bigint>"), F.array_repeat(F.lit(0).cast("long"), F.lit(width) - F.size("raw")))
    rows = stored(sound.select("id", padded.alias("v"), "label", "__anchor").groupBy("id", "v", "label").agg(F.max("__anchor").alias("anchor")), "vectors")

    first = F.row_number().over(Window.partitionBy("v", "label").orderBy("id"))
    few = rows.withColumn("nth", first).filter(F.col("nth") <= max(most, negatives)).groupBy("v", "label")
    points = stored(few.agg(F.sort_array(F.collect_list("id")).alias("ids")), "points")
    index = build(points, width, longest, points.count())

    wide = 1 << 62
    distinct = rows.filter("anchor").groupBy("v", "label").agg(F.count(F.lit(1)).alias("n")).select(
        F.monotonically_increasing_id().alias("q"), "v", "label", F.array(F.lit(-wide)).alias("least"), F.array(F.lit(wide)).alias("greatest")
    )
    queries = stored(distinct, "queries")
    count = queries.count()
    found = search(queries, index, width, count, most, True)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("found")
    # One window for each different score of a positive; one that no score fits stays empty.
    scores = F.array_distinct(F.transform("found", lambda x: x["score"]))
    with_positives = stored(
        queries.select("q", "v", "label").join(found.groupBy("q").agg(ordered), "q").select(
            "q", "v", "label", "found", scores.alias("scores"),
            F.transform(scores, lambda p: -_hundredth(-p * at_least)).alias("least"),
            F.transform(scores, lambda p: _hundredth(p * at_most)).alias("greatest"),
        ), "positives",
    )
    hard = search(with_positives.select("q", "v", "label", "least", "greatest"), index, width, count, negatives, False)
    by_window = hard.groupBy("q", "w").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("hard")).groupBy("q")
    listed = by_window.agg(F.map_from_entries(F.collect_list(F.struct("w", "hard"))).alias("hard"))
    # Stored, so that the join with the anchors can split a frequent vector.
    answers = stored(with_positives.join(listed, "q").select("v", "label", "found", "scores", "hard"), "answers")

    anchors = rows.filter("anchor").select("id", "v", "label")
    joined = anchors.join(answers, ["v", "label"]).select(
        F.col("id").alias("anchor_id"), "scores", "hard",
        F.explode(F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, positives)).alias("p"),
    )
    window = (F.array_position("scores", F.col("p.score")) - 1).cast("int")
    each = joined.select("anchor_id", "p", F.explode(F.try_element_at("hard", window)).alias("n"))
    return each.select(
        "anchor_id", F.col("p.id").alias("positive_id"), F.col("n.rank").cast("int").alias("rank"), F.col("n.id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )


def negatives_by_anchor(embeddings: DataFrame) -> DataFrame:
    """Hard negatives of the vectors whose id is divisible by 50, after each seventh label is made wrong."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = embeddings.filter(_is_sound("embedding")).select("vec_id", scaled("embedding").alias("embedding"), label.alias("label"))
    return hard_negatives(whole, F.col("vec_id") % 50 == 0)


SQL = """
WITH sound AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scores AS (
  SELECT a.vec_id AS anchor, a.label AS anchor_label, r.vec_id AS id, r.label, list_inner_product(a.v, r.v)::BIGINT AS score
  FROM sound a JOIN sound r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
),
positives AS (
  SELECT anchor, anchor_label, id, score FROM scores WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
),
negatives AS (
  SELECT p.anchor, p.id AS positive, p.score AS positive_score, s.id AS negative, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY s.score DESC, s.id) AS nth
  FROM positives p JOIN scores s ON s.anchor = p.anchor AND s.label <> p.anchor_label
  WHERE 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, nth::INTEGER AS "rank", negative AS negative_id, positive_score, negative_score
FROM negatives WHERE nth <= 3"""
