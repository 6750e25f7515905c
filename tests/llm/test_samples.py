"""Bounded samples, many languages, repeated ids; line dedup by its two ways; quality and packing against plain versions."""

import collections
import random

import numpy as np
import pytest

from corvane.llm import common, langid, line_dedup, packing, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], DOCS)


def test_many_languages_and_one_id_repeated(spark):
    """60 languages of their own letters, and 20,000 rows of one id and text, which teach once."""
    rng = random.Random(3)
    tags = [c for codes in langid.FAMILIES.values() for c in codes][:60]
    letters = {c: rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèçñ", 9) for c in tags}
    text = lambda c: " ".join("".join(rng.choice(letters[c]) for _ in range(rng.randint(3, 8))) for _ in range(60))
    rows = [(k * 100 + i, text(c), c, "s") for k, c in enumerate(tags) for i in range(12)]
    docs = docs_of(spark, rows)
    model = langid.train(docs, per_language=8)
    assert sum(map(len, model.languages.values())) == 60
    found = langid.predict(docs, model).where(langid.held_out()).selectExpr("avg(cast(lang_pred = lang as int))").first()[0]
    assert found >= 0.7
    judged = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs, model).limit(200).collect()}
    for i, x, _, _ in rows:
        if i in judged:
            (tag,), (score,) = langid.decide(model, np.stack([langid.profile(x)]))
            assert judged[i][0] == tag and judged[i][1] == pytest.approx(score, abs=1e-5)
    same = docs.unionByName(docs.where("doc_id = 0").selectExpr("explode(sequence(1, 20000)) as x", "*").drop("x"))
    again = langid.train(same, per_language=8)
    assert all(np.allclose(again.pairs[k], model.pairs[k]) for k in model.pairs) and np.allclose(again.family_w, model.family_w)


def test_line_dedup_by_both_ways(spark):
    rng = random.Random(1)
    lines = [f"line {i}" for i in range(40)]
    rows = [(i % 50, "\n".join(rng.choice(lines[: 40 - i % 20]) for _ in range(12)), "en", rng.choice(["a", "b", None])) for i in range(120)]
    rows += [(500, None, "en", "a"), (501, "", "en", "c"), (502, rows[0][1], "en", rows[0][3])]
    docs = docs_of(spark, rows).selectExpr("*", "7 as n_lines", "'k' as __key")
    for how in ({}, {"min_pages": 4}, {"distinct_pages": True, "max_ratio": 0.3}):
        near, far = (sorted(map(str, line_dedup.drop_lines(docs, broadcast_rows=n, **how).collect())) for n in (10**6, 0))
        assert near == far and len(near) == len(rows)
    pages = collections.Counter(s for _, t, _, s in rows if t is not None)
    shown = collections.Counter((s, x) for _, t, _, s in rows if t is not None for x in set(t.split("\n")) if x.strip())
    want = sorted(str((i, None if t is None else "\n".join(x for x in t.split("\n") if not x.strip() or shown[s, x] / pages[s] <= 0.3))) for i, t, _, s in rows)
    got = line_dedup.drop_lines(docs, max_ratio=0.3).select("doc_id", "text")
    assert sorted(str(tuple(r)) for r in got.collect()) == want


def test_quality_fit_against_plain(spark):
    """The fitted evidence: features, label join and Newton steps on the driver, without the sample's limit."""
    rng = random.Random(9)
    good = lambda: " ".join(rng.choice(["the", "river", "ran", "under", "old", "bridges", "slowly"]) for _ in range(40)) + "."
    bad = lambda: " | ".join(rng.choice(["BUY", "NOW", "$$$", "!!!", "CLICK"]) for _ in range(40))
    rows = [(i, good() if i % 2 else bad(), "en", f"s{i % 3}") for i in range(80)] + [(90, None, "en", "s"), (91, "", None, None), (92, "long " * 60_000, "en", "s0")]
    labels = [(i, i % 2) for i in range(60)] + [(3, 0), (None, 1), (77, None)]
    got = {r["doc_id"]: r for r in quality.classify(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    known = {i: i % 2 for i in range(60) if i != 3}
    texts = {i: t for i, t, _, _ in rows}
    model = quality.fit(np.array([quality.features(texts[i]) for i in known]), np.array(list(known.values()), float))
    for i, t in texts.items():
        logit = model.bias + sum(w * x for w, x in zip(model.weights, quality.features(t)))
        assert got[i]["evidence"] == pytest.approx(np.clip(logit, -quality.MOST_LOGIT, quality.MOST_LOGIT) - model.base, abs=1e-3)
    assert all(got[i]["kept"] == bool(i % 2) for i in range(80))


def test_pack_of_one_shard_against_best_fit(spark):
    rng = random.Random(5)
    rows = [(i, f"s{rng.randrange(30)}", rng.randrange(1, 700), None if i % 5 == 0 else rng.randrange(40)) for i in range(150)] + [(900, "big", 512 * 3000 + 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, cluster long")
    out = packing.pack(df, capacity=512, shard=10**6).collect()
    assert sum(r["n_tokens"] for r in out) == sum(r[2] for r in rows) and sum(r["doc_id"] == 900 for r in out) == 3001
    rest = sorted(((n % 512, i, s, c) for i, s, n, c in rows if n % 512), key=lambda x: (-x[0], str(x[1])))
    code = lambda values: [-1 if v is None else sorted(map(str, set(values))).index(str(v)) for v in values]
    bins = packing.best_fit([x[0] for x in rest], code([x[2] for x in rest]), code([x[3] for x in rest]), 512)
    want, got = collections.defaultdict(set), collections.defaultdict(set)
    for b, x in zip(bins, rest):
        want[b].add(x[1])
    for r in out:
        if r["n_tokens"] < 512:
            got[r["bin_id"]].add(r["doc_id"])
    assert sorted(map(sorted, want.values())) == sorted(map(sorted, got.values()))


def test_small_batches_put_the_setting_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen = spark.conf.get(name), []
    for own in ("0", "100", "5000"):
        spark.conf.set(name, own)
        try:
            with common.small_batches(spark, 300):
                seen.append(spark.conf.get(name))
                raise KeyError
        except KeyError:
            pass
        assert spark.conf.get(name) == own
    spark.conf.set(name, before)
    assert seen == ["300", "100", "300"]
