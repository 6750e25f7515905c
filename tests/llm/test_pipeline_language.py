"""The language stage of the pipeline against the same rule row by row, with planted rows."""

import random

import numpy as np

import corpus_pipeline
from corvane.llm import langid


def test_language_stage_decides(spark):
    rng = random.Random(1)
    junk = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(300)) for _ in range(20)]
    finnish = "Tämä on suomenkielinen teksti, jota malli ei ole koskaan nähnyt, ja sen pitäisi jäädä pois. " * 3
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    # Planted rows have held-out ids, so they teach nothing.
    ids = [r["id"] for r in spark.range(10**6, 10**6 + 400).where(langid.held_out("id")).collect()]
    real = docs.where("lang = 'de' and n_chars > 1000").orderBy("doc_id").limit(20).collect()
    texts = [(x, "en") for x in [*junk, finnish]] + [(r["text"], tag) for r in real for tag in ("es", None)]
    planted = [(i, x, tag, "s", len(x)) for i, (x, tag) in zip(ids, texts)]
    assert len(planted) == len(texts)
    docs = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string, lang string, source string, n_chars long").select([docs.schema[c].name for c in docs.columns]))
    got = {r["doc_id"]: r["lang"] for r in corpus_pipeline.identify_language(spark, docs, "").collect()}

    model, want = langid.train(docs), {}
    for r in docs.collect():
        if langid.has_letter(r["text"]):
            (tag,), (score,) = langid.decide(model, np.stack([langid.profile(r["text"])]))
            if score >= langid.LEAST:
                want[r["doc_id"]] = tag if score >= langid.SURE or r["lang"] is None else r["lang"]
    assert got == want
    assert not {i for i, *_ in planted[: len(junk) + 1]} & set(got)
    assert [got[i] for i, *_ in planted[len(junk) + 1 :]].count("de") >= 0.9 * 2 * len(real)
    clean = docs.where("doc_id < 1000000 and lang is not null").where("n_chars > 100").count()
    assert sum(i < 10**6 for i in got) >= 0.95 * clean
