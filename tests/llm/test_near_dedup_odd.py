"""Near-dedup of odd tables: none, repeated ids, clashing columns, a very long text."""

from pyspark.sql import functions as F

from corvane.llm import near_dedup


def test_odd_tables(spark):
    long = " ".join(f"w{i * 7919 % 100003}" for i in range(150_000))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(1, long), (2, long.replace("w7919 ", "x ", 1)), (3, other), (3, other), (4, None), (5, ""), (None, other.upper()), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clashing = docs.withColumns({c: F.lit("mine") for c in ("root", "key", "sketch", "n", "block", "keys", "node", "component", "__i")})
    out = near_dedup.one_of_each(clashing)
    assert out.columns == clashing.columns
    kept = out.collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3, 4]
    assert all(r["root"] == r["key"] == r["component"] == "mine" for r in kept)
    assert near_dedup.one_of_each(clashing.limit(0)).count() == 0 and near_dedup.grouped(docs.limit(0)).count() == 0
    assert near_dedup.grouped(docs).count() == len(rows)
