"""Hard negatives against all inner products."""

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidyveil.llm import hard_negatives as h

SCHEMA = "vec_id long, embedding array<float>, label int, score string, q int"


def _brute(rows, positives=5, negatives=3):
    sound, seen = [], set()
    for i, v, label, *_ in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = tuple(math.floor(256 * float(np.float32(x))) for x in v)
        label = (label + 1) % 10 if i % 7 == 0 else label
        if (i, whole, label) not in seen:
            seen.add((i, whole, label))
            sound.append((i, whole, label))
    out = []
    for i, v, label in sound:
        if i % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), j, m) for j, w, m in sound if j != i]
        for minus, j, _ in sorted(s for s in scores if s[2] == label)[:positives]:
            p = -minus
            fits = sorted(s for s in scores if s[2] != label and 50 * p <= -100 * s[0] <= 95 * p)
            out += [(i, j, r, k, p, -n) for r, (n, k, _) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def _rows(seed, n, width=6):
    """Some families of near vectors, one vector that a third of the rows share, and what takes no part."""
    rng, rows = random.Random(seed), []
    middles = [[rng.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    for i in range(n):
        middle = rng.choice(middles)
        v = list(middles[0]) if i % 3 == 0 else [x + rng.gauss(0, 0.2) for x in middle]
        rows.append((i, v, rng.randrange(4), "x", 1))
    odd = [(None, v, 1, "x", 1), (n, None, 1, None, 1), (n + 1, v, None, "x", 1), (n + 2, [], 2, "x", 1), (n + 3, v[:2], 3, "x", 1)]
    odd += [(n + 4, [float("nan"), *v[1:]], 1, "x", 1), (n + 5, [float("inf"), *v[1:]], 1, "x", 1), (n + 6, [None, *v[1:]], 1, "x", 1), (50, rows[50][1], rows[50][2], "again", 2)]
    return rows + odd


@pytest.mark.parametrize("small", [False, True])
def test_by_anchor(spark, monkeypatch, small):
    if small:  # many cells, blocks, slots and leaves
        for name, value in (("BLOCK", 16), ("TOGETHER", 3), ("LEAF", 3), ("FAN", 4), ("SAMPLE", 100)):
            monkeypatch.setattr(h, name, value)
        monkeypatch.setattr(h.cover_tree, "__defaults__", (3, 4))
    rows = _rows(7 + small, 700)
    df = spark.createDataFrame(rows, SCHEMA)
    found = sorted(tuple(r) for r in h.negatives_by_anchor(df).collect())
    assert found == _brute(rows) and len(found) > 60


def test_other_numbers_and_odd_tables(spark):
    rows = _rows(3, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    whole = df.filter(h._is_sound("embedding")).withColumn("embedding", h.scaled("embedding"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = h.hard_negatives(whole.withColumn("label", label), F.col("vec_id") % 50 == 0, positives=2, negatives=7)
    assert sorted(tuple(r) for r in found.collect()) == _brute(rows, 2, 7)
    assert h.negatives_by_anchor(df.limit(0)).collect() == []
    assert h.hard_negatives(whole, F.lit(None).cast("boolean")).collect() == []
    alone = spark.createDataFrame([(50, [1.0, 0.0], 1), (51, [0.5, 0.0], 1), (53, [0.4, 3.0], 2)], "vec_id long, embedding array<float>, label int")
    assert sorted(tuple(r) for r in h.negatives_by_anchor(alone).collect()) == _brute([tuple(r) for r in alone.collect()])
    huge = spark.createDataFrame([(50, [1e30], 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(Exception, match="too large|overflow"):
        h.hard_negatives(huge, F.lit(True)).collect()


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 120), st.integers(1, 5))
def test_tree_and_bounds(seed, n, width):
    rng = np.random.default_rng(seed)
    points = np.round(rng.normal(0, 40, (n, width)) * rng.integers(0, 2, (n, 1)))
    longest = float((points**2).sum(axis=1).max())
    around, tree = h.augmented(points, longest), h.cover_tree(h.augmented(points, longest), 3, 4)
    assert sorted(tree.order) == list(range(n))

    def below(node):
        if tree.leaf[node]:
            return list(tree.order[tree.first[node] : tree.last[node]])
        return [p for c in range(tree.first[node], tree.last[node]) for p in below(c)]

    query = np.round(rng.normal(0, 40, (1, width)))
    low, high = h.bounds(query @ points[tree.center].T, (query**2).sum(axis=1), tree.radius, longest)
    for node in range(len(tree.center)):
        under = below(node)
        away = np.sqrt(((around[under] - around[tree.center[node]]) ** 2).sum(axis=1))
        assert away.max() <= tree.radius[node] + 1e-9
        scores = points[under] @ query[0]
        assert low[0, node] <= scores.min() and scores.max() <= high[0, node]


def test_descent_skips_nodes():
    """On clustered points the search looks at few leaves."""
    rng = np.random.default_rng(1)
    middles = rng.normal(0, 100, (40, 8))
    points = np.round(np.repeat(middles, 50, axis=0) + rng.normal(0, 3, (2000, 8)))
    longest = float((points**2).sum(axis=1).max())
    block = h.Block(points, np.zeros(2000, np.int64), [np.array([i]) for i in range(2000)], longest)
    query, wide = points[700], np.array([[float(1 << 62)]])
    scores = points @ query
    best = [(int(scores[i]), int(i)) for i in np.lexsort((np.arange(2000), -scores))[:5]]
    for one in (block, h.Block.unpack(block.pack())):
        seen = []
        real = one.points
        one.points = type("Seen", (), {"__getitem__": lambda self, at, real=real, seen=seen: (seen.append(len(at)), real[at])[1]})()
        found = one.search(query[None], np.array([0]), -wide, wide, 5, True)
        assert [(s, i) for _, _, s, i in found.tolist()] == best
        assert sum(seen) < 700
