"""Candidate sets, their files and the closest of them, against plain walks, and what their plans shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import matching as M

MEMBERS, FILES = "unit string, ord int, name string, crc long, size long", "set string, ord int, name string, crc long, size long, no_dump boolean"


def tables(spark, seed):
    r = random.Random(seed)
    name = lambda: r.choice([None, "a", "A", "b", "c", "D", "e"])
    crc = lambda: r.choice([None, *range(9)])
    members = {(f"u{r.randrange(12)}", i, name(), crc(), r.randrange(2)) for i in range(70)}
    files = {(f"s{r.randrange(12)}", i, name(), crc(), r.randrange(2), r.random() < 0.3) for i in range(60)}
    return spark.createDataFrame(sorted(members, key=str), MEMBERS), spark.createDataFrame(sorted(files, key=str), FILES)


def walk(members, files):
    members, files = [tuple(r) for r in members.collect()], [tuple(r) for r in files.collect()]
    low = lambda x: x and x.lower()
    is_name = lambda m, f: m[2] is not None and low(m[2]) == low(f[2])
    is_content = lambda m, f: not f[5] and m[3] is not None and m[3:5] == f[3:5]
    pairs = {(m[0], f[0]) for m in members for f in files if is_content(m, f) or (f[5] and is_name(m, f))}
    out, best = [], {}
    for u, s in pairs:
        states = []
        for f in (f for f in files if f[0] == s):
            tiers = [(0 if is_name(m, f) else 1, m[1]) for m in members if m[0] == u and is_content(m, f)]
            tiers += [(0 if f[5] else 2, m[1]) for m in members if m[0] == u and is_name(m, f)]
            tier, at = min(tiers, default=(3, None))
            states.append(("good", "renamed", "wrong", "missing")[tier])
            out.append((u, s, f[1], states[-1], at))
        found = sum(x in ("good", "renamed") for x in states)
        best[u] = min(best.get(u, (0, 0, "")), (-found, len(states) - found, s)) if u in best else (-found, len(states) - found, s)
    return sorted(pairs), sorted(out), sorted((u, s, -o, bad) for u, (o, bad, s) in best.items())


@pytest.mark.parametrize("listed", [2, 6, 32])
def test_against_a_walk(spark, monkeypatch, listed):
    monkeypatch.setattr(M, "LISTED", listed)
    for seed in range(2):
        members, files = tables(spark, seed)
        pairs, matched, best = walk(members, files)
        rows = lambda df: sorted(tuple(r) for r in df.collect())
        assert rows(M.candidates(members, files)) == pairs
        assert rows(M.match_candidates(members, files)) == matched
        assert rows(M.closest_sets(members, files)) == best


def hot(spark):
    """200 units and 200 sets that all hold the same undumped file, and one of their own."""
    members = [(f"u{i}", k, n, 10 + i * k, k) for i in range(200) for k, n in enumerate(["hot.bin", "own.bin"])]
    files = [(f"s{i}", k, n, 10 + i * k, k, k == 0) for i in range(200) for k, n in enumerate(["hot.bin", "own.bin"])]
    return spark.createDataFrame(members, MEMBERS), spark.createDataFrame(files, FILES)


def joined(plan):
    """The most rows that a join of an executed plan gave."""
    name, inner = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        inner = [plan.plan()]
    else:
        children = plan.children()
        inner = [children.apply(i) for i in range(children.size())]
    own = plan.metrics().apply("numOutputRows").value() if "Join" in name else 0
    return max([own, *map(joined, inner)])


def above_first_join(df):
    return df._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]


def test_pairs_are_not_shuffled_to_be_told_apart(spark):
    found = M.candidates(*hot(spark))
    assert found.count() == 40_000 and "Aggregate" not in above_first_join(found)


def test_files_of_pairs_are_not_shuffled(spark):
    found = M.match_candidates(*hot(spark))
    assert found.count() == 80_000 and found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_closest_sets_lists_no_pairs_of_a_common_name(spark):
    found = M.closest_sets(*hot(spark))
    jdf = found._jdf
    assert len(jdf.collectAsList()) == 200 and joined(jdf.queryExecution().executedPlan()) <= 2_000


@pytest.mark.parametrize("find", [M.candidates, M.match_candidates])
def test_no_side_of_the_pairs_is_broadcast(spark, find):
    found = find(*hot(spark))
    jdf = found._jdf
    assert len(jdf.collectAsList()) >= 40_000 and "Broadcast" not in jdf.queryExecution().executedPlan().toString()


def test_parts_of_common_tokens_meet_in_many_tasks(spark, monkeypatch):
    for name, n in (("UNITS_OF_A_TASK", 7), ("SETS_OF_A_TASK", 3), ("BUCKETS", 4)):
        monkeypatch.setattr(M, name, n)
    members, files = tables(spark, 2)
    pairs, matched, _ = walk(members, files)
    assert sorted(tuple(r) for r in M.candidates(members, files).collect()) == pairs
    assert sorted(tuple(r) for r in M.match_candidates(members, files).collect()) == matched
    found = M.candidates(*hot(spark)).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in found) == 40_000 and max(r["count"] for r in found) < 4_000


def test_files_whose_bits_are_set_by_others_are_looked_up(spark, monkeypatch):
    members, files = tables(spark, 3)
    members = members.unionByName(members.limit(9).withColumn("unit", F.lit(None).cast("string")))
    want = sorted(map(str, M.match_files(M.candidates(members, files), members, files).collect()))
    assert sorted(map(str, M.match_candidates(members, files).collect())) == want
    # All tokens set all bits.
    monkeypatch.setattr(M, "_bits", lambda token: F.lit(-1).cast("long"))
    assert sorted(map(str, M.match_candidates(members, files).collect())) == want


def test_closest_sets_broadcasts_nothing(spark):
    jdf = M.closest_sets(*hot(spark))._jdf
    assert len(jdf.collectAsList()) == 200 and "Broadcast" not in jdf.queryExecution().executedPlan().toString()
