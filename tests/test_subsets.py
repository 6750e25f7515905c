"""Sets that are part of no other: against all pairs, and how many rows a task gets."""

import random

from pyspark.sql import functions as F

from corvane.operators import matching as M
from corvane.plans import catalog


def part_of(a, b):
    return len(a) < len(b) and a - {None} <= b


def test_subsets_against_all_pairs(spark, monkeypatch):
    r = random.Random(2)
    sets = {(r.choice([0, 1, 2, None]), n): {r.choice([None, *range(7)]) for _ in range(r.randrange(1, 6))} for n in range(120)}
    sets |= {(3, 200): {None}, (3, 201): {None, 5}, (4, 202): {None}, (4, 203): {5}, (5, 204): {1, 2, 3}, (5, 205): {1, 2, 3}, (5, 206): {1, 2}}
    df = spark.createDataFrame([(k, n, e) for (k, n), s in sets.items() for e in s], "k int, n long, e long")
    want = {(k, n, len(s)) for (k, n), s in sets.items() if k is None or not any(k == q and part_of(s, b) for (q, _), b in sets.items())}
    assert 40 < len(want) < len(sets) and {(3, 201, 2), (4, 202, 1), (5, 204, 3), (5, 205, 3)} <= want
    for most, of_a_task in ((100_000, 500_000), (0, 10), (30, 10)):
        monkeypatch.setattr(M, "BROADCAST_ROWS", most, raising=False)
        monkeypatch.setattr(M, "ROWS_OF_A_TASK", of_a_task, raising=False)
        got = [tuple(x) for x in M.without_subsets(df, ["k"], "n", "e").collect()]
        assert len(got) == len(want) and set(got) == want


def test_no_sets(spark):
    assert M.without_subsets(spark.createDataFrame([], "k int, n long, e long"), ["k"], "n", "e").collect() == []


def test_tasks_do_not_grow_with_the_table(spark, monkeypatch):
    made, stored = {}, M.stored
    monkeypatch.setattr(M, "ROWS_OF_A_TASK", 200, raising=False)
    monkeypatch.setattr(M, "stored", lambda df, label: made.setdefault(label, stored(df, label)))
    catalog.QUERIES["subset_elimination"](spark, "/root/testdata/sf0.001").collect()
    for label in made.keys() & {"sets", "whole"}:
        rows = [x["count"] for x in made[label].groupBy(F.input_file_name()).count().collect()]
        assert max(rows) < 400 and sum(rows) > 1000, label  # all 6,000 rows were one task's
