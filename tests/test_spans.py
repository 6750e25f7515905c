"""Ordered operators give the same whether a hot key is dealt by ranges or ordered in one task."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import sequences as S
from corvane.operators import spans


@pytest.fixture(scope="module")
def items(spark):
    """A hot key with two thirds of the rows, a null key, nulls among the values, a few small keys."""
    key = F.when(F.col("id") % 3 > 0, 7).when(F.col("id") % 30 == 0, F.lit(None)).otherwise(F.col("id") % 9)
    value = F.when(F.col("id") % 11 == 0, F.lit(None)).otherwise(F.floor(F.col("id") / 4) % 5)
    return spark.range(3000).select("id", key.cast("int").alias("k"), value.cast("long").alias("v"), (F.col("id") * F.col("id") % 977 + F.col("id") * 10).alias("at"))


def both(monkeypatch, make):
    """Rows by ranges and rows by one task for each key."""
    out = []
    for most in (100, 10**9):
        monkeypatch.setattr(spans, "ROWS_OF_A_KEY", most)
        df = make()
        out.append((sorted(df.columns), sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)))
    return out


OPERATORS = {
    "islands": lambda d: S.islands(d, ["k"], "at", 12, ["id"]),
    "runs": lambda d: S.runs(d, ["k"], ["at", "id"], "v"),
    "longest_run": lambda d: S.longest_run(d, ["k"], ["at", "id"], "v"),
    "forward_fill": lambda d: S.forward_fill(d, ["k"], ["at", "id"], F.when(F.col("id") % 700 == 1, F.col("id")), "filled"),
    "novelty": lambda d: S.novelty(d, ["k"], ["at", "id"], "v", "at"),
    "numbered": lambda d: S.numbered(d, ["k"], ["at", "id"], "n"),
    "blocks": lambda d: S.blocks(d, ["k"], ["at", "id"], 5, "id"),
    "recurrence": lambda d: S.recurrence(d, ["k"], "id", "v"),
    "column_profile": lambda d: S.column_profile(d, ["k"], ["at", "id"], "v"),
    "cut_by_next": lambda d: S.cut_by_next(d, ["k"], "at", "id", ["id"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_ranges_change_nothing(monkeypatch, items, name):
    ranges, plain = both(monkeypatch, lambda: OPERATORS[name](items))
    assert plain[1] and ranges == plain


def test_empty(monkeypatch, items):
    for most in (0, 10):
        monkeypatch.setattr(spans, "ROWS_OF_A_KEY", most)
        assert all(f(items.limit(0)).count() == 0 for f in OPERATORS.values())


def test_a_hot_key_is_several_ranges(monkeypatch, items):
    monkeypatch.setattr(spans, "ROWS_OF_A_KEY", 100)
    dealt = spans.spread(items, ["k"], ["at", "id"]).where("k = 7").groupBy(spans.CHUNK).count().collect()
    assert len(dealt) > 3 and max(r["count"] for r in dealt) < 1000
