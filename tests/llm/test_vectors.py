"""Vector operators on ties, repeated ids and large labels, against all pairs."""

import collections
import math

import numpy as np
import pytest

from corvane.llm import embedding_dedup, vptree

SHAPE = "vec_id long, embedding array<float>, label int"


def plain_links(rows):
    """The other ids that each id is linked with, over all rows."""
    out = collections.defaultdict(set)
    for i, a, one in rows:
        for j, b, two in rows:
            if i != j and one == two and np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.98:
                out[i].add(j)
    return out


def check_dedup(df, rows, **how):
    links = plain_links(rows)
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, **how).collect()}
    assert set(got) == {r[0] for r in rows}
    for i in got:
        reach, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in links[todo.pop()] if j not in reach])
            reach.update(new)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links[i]), min(reach), min(reach) == i), i


def test_rows_of_one_id_all_link(spark):
    rows = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 0), (2, [1.0, 0.0], 0), (3, [0.0, 1.0], 0), (4, [1.0, 0.01], 0), (4, [0.0, 1.0], 0), (4, [1.0, 1.0], 0), (5, [1.0, 1.0], 1), (6, [1.0, 1.0], 0), (6, [1.0, 1.0], 0)]
    check_dedup(spark.createDataFrame(rows, SHAPE), rows)


def test_repeated_ids_in_a_large_label(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((12, 16))
    rows = [(int(rng.integers(0, 150)), (base[i % 12] + rng.standard_normal(16) * 0.05).astype(np.float32).tolist(), 0) for i in range(260)]
    for how in ({}, {"block": 16}, {"block": 16, "plain": 1}):
        check_dedup(spark.createDataFrame(rows, SHAPE), rows, **how)


def test_tables_leave_no_pair_out(spark):
    """Of 20,000 pairs at the threshold, all share a cell of the tables."""
    rng = np.random.default_rng(2)
    x, _ = embedding_dedup.unit(rng.standard_normal((20_000, 32)))
    side = rng.standard_normal((20_000, 32))
    side, _ = embedding_dedup.unit(side - (side * x).sum(1, keepdims=True) * x)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * side
    n = embedding_dedup.tables(12)
    assert (embedding_dedup.cells(x, 12, n) == embedding_dedup.cells(y, 12, n)).any(1).all()
    far = (embedding_dedup.cells(x, 12, n) == embedding_dedup.cells(x[::-1], 12, n)).any(1).mean()
    assert far < 0.05


def test_no_vectors(spark):
    none = spark.createDataFrame([], SHAPE)
    assert embedding_dedup.near_duplicate_vectors(none).count() == 0 and vptree.nearest(none, none).count() == 0
    rows = spark.createDataFrame([(None, [1.0, 0.0], 0), (7, [1.0, 0.0], 0), (None, [1.0, 0.0], 0)], SHAPE)
    assert sorted(map(tuple, embedding_dedup.near_duplicate_vectors(rows).collect()), key=str) == [(7, 0, 7, True), (None, 0, None, False)]


def test_many_different_vectors_tie(spark):
    """400 vectors at cosine 0 from the query: the smallest ids win, wherever the vectors lie."""
    rng = np.random.default_rng(3)
    rows = [(0, [1.0] + [0.0] * 20, 0)] + [(i, [0.0] + rng.integers(-9, 10, 20).astype(float).tolist(), 0) for i in range(1, 407)]
    df = spark.createDataFrame(rows, SHAPE)
    for shard, sample in ((4096, 4096), (64, 4096), (32, 10)):
        got = [r["vec_id"] for r in vptree.nearest(df, df.where("vec_id = 0"), shard=shard, sample=sample, leaf=16).orderBy("rank").collect()]
        assert got == [1, 2, 3, 4, 5], (shard, sample)


def test_nearest_of_repeated_ids(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(0, 90)), rng.standard_normal(6).astype(np.float32).tolist(), 0) for _ in range(300)]
    df = spark.createDataFrame(rows, SHAPE)
    best = collections.defaultdict(dict)
    for i, a, _ in rows:
        for j, b, _ in rows:
            if i % 10 == 0 and i != j:
                score = np.dot(a, b) / math.sqrt(np.dot(a, a) * np.dot(b, b))
                best[i][j] = max(best[i].get(j, -2), score)
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 10 = 0"), shard=40, leaf=8).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {i: sorted(b, key=lambda j: (-b[j], j))[:5] for i, b in best.items()}


def plain_nearest(rows, k=5):
    out = []
    for q, x in {(i, v) for i, v in rows if i % 50 == 0}:
        best = {}
        for i, v in rows:
            if i != q:
                best[i] = max(best.get(i, -2.0), vptree.cosines(np.array([x]), np.array([v]))[0])
        out += [(q, i, s) for i, s in best.items()]
    best = {}
    for q, i, s in out:
        best[q, i] = max(best.get((q, i), -2.0), s)
    found = []
    for q in {q for q, _ in best}:
        ranked = sorted(((s, i) for (p, i), s in best.items() if p == q), key=lambda x: (-x[0], x[1]))[:k]
        found += [(q, at, i) for at, (_, i) in enumerate(ranked, 1)]
    return sorted(found)


@pytest.mark.parametrize("kind", ["equal", "different", "parallel"])
def test_thousands_of_rows_of_one_id(spark, kind):
    rng = np.random.default_rng(11)
    same = [0.25, 0.5, -0.75]
    of_one = {"equal": [same] * 9000, "different": rng.normal(size=(3000, 3)).tolist(), "parallel": [[x * c for x in same] for c in (1.0, 2.0, 3.0, 0.1)] * 5}[kind]
    rows = [(1, v) for v in of_one] + [(i, rng.normal(size=3).tolist()) for i in (50, 100, 100, *range(150, 400, 7))]
    rows = [(i, tuple(v)) for i, v in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=500).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == plain_nearest(list(set(rows)))


def test_scores_come_from_the_vectors_as_they_are(spark):
    rows = [(0, [0.2, 0.6]), (8, [0.3, 0.9]), (50, [0.2, 0.6]), (51, [1e200, 3e200]), (52, [3e-300, 9e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["score"] for r in vptree.nearest(df, df.where("vec_id = 0")).collect()}
    assert len(got) == 4 and got[50] == vptree.cosines(np.array([[0.2, 0.6]]), np.array([[0.2, 0.6]]))[0] and all(abs(s - 1) < 1e-12 for s in got.values())
