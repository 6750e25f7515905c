"""Hard negatives by dual-tree search against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import hard_negatives as hard

SCHEMA = "vec_id long, label int, embedding array<double>"
MOST = (1 << 63) - 1


def plain(rows, positives=5, negatives=10):
    once = {}
    for i, label, vector in rows:
        if i is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        if i not in once or (label, vector) < once[i]:
            once[i] = (label, vector)
    whole = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in once.items()}
    out = []
    for a, (own, v) in whole.items():
        if a % 100:
            continue
        scores = [(max(-MOST, min(MOST, sum(x * y for x, y in zip(v, w)))), i, label) for i, (label, w) in whole.items() if i != a and len(w) == len(v)]
        scores.sort(key=lambda x: (-x[0], x[1]))
        for p, i, _ in [x for x in scores if x[2] == own][:positives]:
            fit = [(s, j) for s, j, label in scores if label != own and 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(a, i, at, j, p, s) for at, (s, j) in enumerate(fit, 1)]
    return sorted(out)


def ours(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as shard", "2 as asks", "3 as dim", "4 as rank", "5 as cell")
    return sorted(tuple(r) for r in hard.hard_negatives(df, F.col("vec_id") % 100 == 0, **more).collect())


def vectors(r, n, dim, labels=4):
    return [(i, r.randrange(labels), [r.gauss(0.1, 0.3) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("shard", [40, 8192])
def test_against_all_pairs(spark, shard):
    r = random.Random(shard)
    rows = vectors(r, 900, 6)
    assert ours(spark, rows, shard=shard) == plain(rows)


def test_ties_repeats_nulls_lengths_and_zeros(spark):
    r = random.Random(3)
    same = [0.5, 0.25, 0.125]
    rows = [(i, i % 3, same) for i in range(0, 400)] + [(i, r.randrange(3), [round(r.random() * 2) / 4 for _ in range(3)]) for i in range(400, 800)]
    rows += [(i, i % 2, [r.random(), r.random()]) for i in range(800, 905)] + [(900, 0, [0.0, 0.0]), (1000, 1, [0.0, 0.0]), (1001, 1, [0.0, 0.0]), (1002, 0, [0.0, 0.0])]
    rows += [(1100, 2, None), (1200, None, same), (None, 1, same), (1300, 1, [0.1, None, 0.2]), (1400, 1, [math.nan, 1.0, 1.0]), (1500, 1, [math.inf, 1.0, 1.0]), (1600, 1, []), (1700, 1, []), (1701, 2, [])]
    rows += [(0, 0, same), (100, 2, [0.1, 0.2, 0.3]), (100, 1, [0.3, 0.2, 0.1]), (5, 1, [0.4, 0.4, 0.4])]
    r.shuffle(rows)
    want = plain(rows)
    assert ours(spark, rows, shard=64) == want and ours(spark, rows) == want


def test_scores_beyond_doubles_and_longs(spark):
    r = random.Random(4)
    rows = [(i, i % 2, [float(r.randrange(-(1 << 40), 1 << 40)) / 256 + 0.0 for _ in range(3)]) for i in range(300)]
    rows += [(i, i % 2, [r.random() * 1e12, r.random() * 1e12, 1e12]) for i in range(300, 420)]
    assert ours(spark, rows, shard=50) == plain(rows)


def test_empty_tables_and_single_rows(spark):
    assert ours(spark, []) == []
    assert ours(spark, [(0, 1, [1.0, 2.0])]) == []
    assert ours(spark, [(0, 1, [1.0]), (1, 1, [1.0])]) == []
    assert ours(spark, [(0, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.5])]) == [(0, 1, 1, 2, 65536, 32768)]
    assert ours(spark, [(1, 1, [1.0]), (2, 2, [0.5])]) == []


def test_a_third_of_all_rows_is_one_vector(spark):
    r = random.Random(6)
    rows = [(i, 1, [0.5, 0.5]) for i in range(3000)] + [(i, r.randrange(5), [r.random(), r.random()]) for i in range(3000, 6000)]
    got = ours(spark, rows, shard=500)
    assert got == plain(rows)


def test_intervals_hold_and_prune():
    rng = np.random.default_rng(1)
    points = np.floor(np.concatenate([rng.normal(c, 0.02, (400, 8)) for c in (-1, 0, 1)]) * 256)
    anchors = np.floor(rng.normal(1, 0.02, (200, 8)) * 256)
    one, two = (hard.Ball(x, np.arange(len(x)), 32) for x in (anchors, points))
    nodes = [two]
    while nodes:
        y = nodes.pop()
        nodes += y.halves
        low, high = hard.interval(one, y)
        products = anchors @ points[y.rows].T
        assert low <= products.min() and products.max() <= high
    visited, free = [], np.full((200, 1), np.inf)
    a, _, row, score = hard.dual_search(anchors, points, lambda x, y: np.ones((len(x), len(y)), bool), -free, free, 3, visited=visited)
    every = anchors @ points.T
    want = -np.sort(-every, axis=1)[:, :3]
    for i in range(200):
        assert (-np.sort(-score[a == i])[:3] == want[i]).all() and (every[i, row[a == i]] == score[a == i]).all()
    assert sum(visited) < every.size / 2


def test_bounds():
    for p in (-7, 0, 1, 2, 3, 10, 99, 12345678901234567890):
        low, high = hard.bounds(p)
        assert 30 * p <= 100 * low and 100 * high <= 90 * p and not 30 * p <= 100 * (low - 1) and not 100 * (high + 1) <= 90 * p
