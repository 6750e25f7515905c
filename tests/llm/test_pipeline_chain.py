"""The whole pipeline against the rules of its stages, each written plainly and fed with what the one before left."""

import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd

import corpus_pipeline
from corvane.llm import entries, langid, line_dedup
from corvane.sources.tables import table

sys.path.insert(0, "/root/repo/tests/llm")
from test_near_dedup import plain_groups  # noqa: E402

SF = "/root/testdata/sf0.001"


def by_language(rows, model):
    out = []
    for i, text, lang, source in rows:
        if text is not None and langid.has_letter(text):
            (tag,), (score,) = langid.decide(model, np.stack([langid.profile(text)]))
            if score >= langid.LEAST:
                out.append((i, text, tag if score >= langid.SURE or lang is None else lang, source))
    return out


def without_boilerplate(rows):
    bare = lambda line: line.strip(line_dedup.BLANKS)
    pages, shown = defaultdict(set), defaultdict(set)
    for _, text, _, source in rows:
        pages[source].add(text)
        for line in filter(None, map(bare, text.split("\n"))):
            shown[source, line].add(text)
    drop = {k for k, v in shown.items() if len(v) >= line_dedup.MIN_PAGES and len(v) / len(pages[k[0]]) > line_dedup.MAX_RATIO}
    return [(i, "\n".join(x for x in text.split("\n") if (source, bare(x)) not in drop), lang, source) for i, text, lang, source in rows], drop


def one_of_each(rows):
    root = plain_groups({i: text for i, text, *_ in rows})
    return [r for r in rows if root[r[0]] == r[0]]


def test_the_chain_against_plain_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    real = docs.collect()
    long = next(r for r in sorted(real, key=lambda r: r["doc_id"]) if r["n_chars"] and 2000 < r["n_chars"] < 20000 and r["lang"])
    words = long["text"].split(" ")
    near = " ".join(words[:-1] + ["changed"])
    footer = "\nAll rights are with the owners of this page of ours."
    teaches = spark.range(10**6, 10**6 + 400).where(langid.held_out("id")).limit(40).collect()
    ids = [r["id"] for r in teaches]
    planted = [(ids[0], long["text"]), (ids[1], near), (ids[2], "12345 67890"), (ids[3], None), (ids[4], "")]
    singles = [r for r in real if r["text"] and r["n_chars"] > 400][:20]
    planted += [(i, r["text"] + footer) for i, r in zip(ids[5:25], singles)]
    more = spark.createDataFrame([(i, x, None, "planted", len(x or "")) for i, x in planted], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(docs.columns)).write.parquet(f"{tmp_path}/documents.parquet")

    rows = [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in table(spark, str(tmp_path), "documents").collect()]
    assert len({r[0] for r in rows}) == len(rows)
    rows = by_language(rows, langid.train(table(spark, str(tmp_path), "documents")))
    assert not {ids[2], ids[3], ids[4]} & {r[0] for r in rows}
    rows, dropped = without_boilerplate(rows)
    assert ("planted", footer.strip()) in dropped
    rows = one_of_each(rows)
    kept = {r[0] for r in rows}
    assert not {ids[0], ids[1]} & kept and long["doc_id"] in kept | {min(kept)}

    con = duckdb.connect()
    con.register("documents", pd.DataFrame([(i, x, s) for i, x, _, s in rows], columns=["doc_id", "text", "source"]))
    want = Counter()
    for i, n in con.execute(f"SELECT doc_id, n_tokens FROM ({entries.MIXING_SQL})").fetchall():
        want[i] += n
    got = Counter()
    bins = defaultdict(list)
    source = {r[0]: r[3] for r in rows}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        got[r["doc_id"]] += r["n_tokens"]
        bins[r["bin_id"]].append(r)
    assert {i: n for i, n in got.items() if n} == {i: n for i, n in want.items() if n}
    for held in bins.values():
        assert len({r["doc_id"] for r in held}) == len(held) and sum(r["n_tokens"] for r in held) <= corpus_pipeline.packing.CAPACITY
        sources = [source[r["doc_id"]] for r in held if source[r["doc_id"]] is not None]
        assert len(set(sources)) == len(sources)


def test_empty_documents(spark, tmp_path):
    table(spark, SF, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
