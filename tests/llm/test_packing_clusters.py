"""Near copies never share a sequence, and null texts conflict with nothing."""

from corvane.llm import entries


def test_near_copies_are_apart(spark, tmp_path):
    words = lambda g: [f"g{g}w{i}" for i in range(60)]
    rows = [(g * 3 + k, f"s{g}-{k}", " ".join([*words(g)[:-1], f"end{k}"])) for g in range(8) for k in range(3)]
    rows += [(100 + i, f"n{i}", None) for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = entries.op10_best_fit_packing(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    seen = [(r["bin_id"], r["doc_id"] // 3) for r in out if r["doc_id"] < 100]
    assert len(set(seen)) == len(seen)
    assert len({r["bin_id"] for r in out}) == 3 and len({r["bin_id"] for r in out if r["doc_id"] >= 100}) == 1
