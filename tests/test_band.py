"""Pairs that are close in all bands, against all pairs, and how many rows meet for them."""

import random

from test_identification import joined

from corvane.operators import matching as M
from corvane.operators import spans


def test_band_against_all_pairs(spark, monkeypatch):
    r = random.Random(1)
    items = [(r.choice([0, 1, None]), r.choice([None, float("nan"), *[r.uniform(-4, 4) for _ in range(6)]]), r.uniform(-9, 9), i) for i in range(150)]
    df = spark.createDataFrame(items, "k int, v double, w double, i int")
    want = sorted((a[0], a[3], b[3]) for a in items for b in items if a[3] < b[3] and a[0] is not None and a[0] == b[0] and None not in (a[1], b[1]) and abs(a[1] - b[1]) <= 0.5 and abs(a[2] - b[2]) <= 3)
    for most in (2_000_000, 20):
        monkeypatch.setattr(spans, "ROWS_OF_A_KEY", most)
        assert want and sorted(tuple(x) for x in M.band(df, ["k"], [("v", 0.5), ("w", 3.0)], "i").collect()) == want


def exploded(plan):
    name, inner = plan.getClass().getSimpleName(), []
    if name == "AdaptiveSparkPlanExec":
        inner = [plan.executedPlan()]
    elif name.endswith("QueryStageExec"):
        inner = [plan.plan()]
    else:
        inner = [plan.children().apply(i) for i in range(plan.children().size())]
    own = plan.metrics().apply("numOutputRows").value() if name == "GenerateExec" else 0
    return own + sum(map(exploded, inner))


def test_rows_without_a_neighbour_are_not_copied(spark):
    df = spark.range(2000).selectExpr("id div 2 as k", "double(id * 10) as v", "1.0d as w", "id as i").unionByName(spark.createDataFrame([(-1, 0.0, 1.0, -2), (-1, 0.5, 1.0, -1)], "k long, v double, w double, i long"))
    jdf = M.band(df, ["k"], [("v", 1.0), ("w", 1.0)], "i")._jdf
    assert len(jdf.collectAsList()) == 1 and exploded(jdf.queryExecution().executedPlan()) <= 20 and joined(jdf.queryExecution().executedPlan()) <= 20
