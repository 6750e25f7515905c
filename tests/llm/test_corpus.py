"""The operators of the corpus subpackage against plain versions of the same rules, on small tables with odd rows."""

import collections
import math
import re
import sys

import numpy as np
import pytest
import xxhash

from corvane.llm import common, embedding_dedup, langid, licenses, line_dedup, mixing, packing, quality, simhash, url_filter, vptree

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, k string, rank int, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x", 1, "y") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    long = "Anne went home.\n" + "the road and the hill " * 4000
    return docs_of(spark, [(1, "", "en", "a"), (2, None, None, None), (3, "Hello there friend", "en", "a"), (3, "Hello there friend", "en", "a"), (4, long, "en", None), (None, "x y z", "de", "b"), (5, "123 !!", None, "b")])


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 1), (3, 1), (20, 7), (7, 30), (30, 3)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 1, 20: 1, 30: 1, 8: 8, 9: 8}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_line_dedup_by_hand(spark):
    rows = [(i, f"Home | About\nown line {i}\n  Home | About \n", "en", "a") for i in range(5)] + [(9, "Home | About\nother", "en", "b"), (10, "Home | About", "en", "a"), (11, None, "en", "a"), (12, "", "en", None)]
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.drop_lines(docs_of(spark, rows), min_pages=4).collect()}
    assert got[0] == ("own line 0\n", 4, 2) and got[9] == ("Home | About\nother", 2, 0)
    assert got[10] == ("", 1, 1) and got[11] == (None, 0, 0) and got[12] == ("", 1, 0)


def plain_simhash(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))))
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps):
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(fps):
        for j, b in fps[:x]:
            if bin(a ^ b).count("1") <= 2:
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i, _ in fps}


def test_simhash_against_all_pairs(spark, corpus):
    rows = corpus.select("doc_id", "text").collect()
    fps = [(r["doc_id"], plain_simhash(r["text"])) for r in rows]
    groups = plain_groups(fps)
    got = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_duplicates(corpus).collect()}
    assert got == {i: (f, groups[i]) for i, f in fps}
    assert len(set(groups.values())) < len(groups)
    kept = simhash.one_of_each(corpus)
    assert kept.columns == corpus.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(set(groups.values()))


def test_simhash_links_of_close_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**62), 2**62, 40)
    fps = [int(b) for b in base] + [int(b) ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in rng.integers(0, 63, (6, 2))]
    fps = sorted(set(fps))
    linked = common.components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long")))
    got = {r["node"]: r["component"] for r in linked.collect()}
    want = plain_groups([(f, f & (1 << 64) - 1) for f in fps])
    assert {f: got.get(f, f) for f in fps} == want


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    rows = [(i, (base[i % 60] + rng.standard_normal(24) * (0.03 if i >= 60 else 0)).astype(np.float32).tolist(), i % 3) for i in range(240)]
    rows += [(300 + i, rows[60][1], 0) for i in range(30)]
    rows += [(400, None, 1), (401, [0.0] * 24, 1), (402, [float("nan")] + [1.0] * 23, 1), (403, [None] + [1.0] * 23, 1), (404, rows[61][1], None), (405, [], 1), (406, [1e30] * 24, 1), (407, [2e30] * 24, 1), (60, rows[60][1], 0), (408, [1.0, 2.0], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows


def able(rows):
    seen = {}
    for i, e, label in rows:
        if e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            v = np.array(e, np.float64)
            seen[i] = (v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()), label)
    return seen


@pytest.mark.parametrize("block,plain", [(2048, 32), (16, 32), (16, 1)])
def test_embedding_dedup_against_all_pairs(vectors, block, plain):
    df, rows = vectors
    good = {i: v for i, v in able(rows).items() if v[1] is not None}
    links = {i: [j for j in good if j != i and good[j][1] == good[i][1] and len(good[i][0]) == len(good[j][0]) and good[i][0] @ good[j][0] >= 0.98] for i in {r[0] for r in rows} if i in good}
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicate_vectors(df, block=block, plain=plain).collect()}
    assert set(got) == {r[0] for r in rows}
    for i in got:
        reach, todo = {i}, [i]
        while todo:
            todo += (new := [j for j in links.get(todo.pop(), []) if j not in reach])
            reach.update(new)
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(links.get(i, [])), min(reach), min(reach) == i), i
    assert max(len(x) for x in links.values()) > 25


def test_binary_codes_bound_holds():
    rng = np.random.default_rng(0)
    x, _ = embedding_dedup.unit(rng.standard_normal((300, 32)))
    y, _ = embedding_dedup.unit(x + rng.standard_normal((300, 32)) * rng.uniform(0, 0.2, (300, 1)))
    turn = embedding_dedup.rotation(32)
    codes, factors = embedding_dedup.encode(x, turn)
    found = {(a, b) for i, j, _ in embedding_dedup.close_pairs(codes, factors, x, y, turn, 0.9) for a, b in zip(i.tolist(), j.tolist())}
    assert found == set(zip(*(k.tolist() for k in np.nonzero(x @ y.T >= 0.9))))
    signs = (np.unpackbits(codes, axis=1, count=32) * 2.0 - 1) / math.sqrt(32)
    assert abs(np.mean((signs @ (y @ turn).T) / factors[:, None] - x @ y.T)) < 0.01


@pytest.mark.parametrize("shard,sample,leaf", [(4096, 4096, 128), (64, 4096, 8), (16, 7, 4)])
def test_vptree_finds_all(vectors, shard, sample, leaf):
    df, rows = vectors
    good = able(rows)
    got = collections.defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 50 = 0"), shard=shard, sample=sample, leaf=leaf).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["rank"], r["score"]))
    for q in [i for i in good if i % 50 == 0]:
        ranked = sorted(((-float(good[q][0] @ good[j][0]), j) for j in good if j != q and len(good[j][0]) == len(good[q][0])))[:5]
        assert [x[1] for x in got[q]] == list(range(1, len(ranked) + 1))
        assert np.allclose([x[2] for x in got[q]], [-s for s, _ in ranked], atol=1e-12)
    assert vptree.nearest(df.limit(0), df).count() == 0


def test_vptree_ties_of_many_copies(spark):
    """A large group of equal vectors: ties go to the smallest ids, and a query is left out of its own group."""
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.5] if i % 3 else [0.2, float(i), 1.0], 0) for i in range(900)], "vec_id long, embedding array<float>, label int")
    found = {}
    for r in vptree.nearest(df, df.where("vec_id in (1, 4, 700)"), shard=128, leaf=16).orderBy("query_id", "rank").collect():
        found.setdefault(r["query_id"], []).append(r["vec_id"])
    assert found == {1: [2, 4, 5, 7, 8], 4: [1, 2, 5, 7, 8], 700: [1, 2, 4, 5, 7]}


def test_vptree_factor_prunes():
    """Factor one finds the best and leaves leaves out; a smaller one leaves out more and may miss some."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 6))
    units, _ = embedding_dedup.unit(np.repeat(centres, 50, 0) + rng.standard_normal((2000, 6)) * 0.05)
    tree, queries = vptree.build(units, 16), units[::20]
    exact = np.sort(units @ queries.T, axis=0)[-5:].T

    def found(factor):
        visited = []
        q, row = vptree.search(tree, units, queries, 5, factor, visited=visited)
        cosine = [np.sort(units[row[q == i]] @ queries[i])[-5:] for i in range(len(queries))]
        return np.array(cosine), sum(visited) / len(queries)

    leaves = len(list(_leaves(tree)))
    best, seen = found(1.0)
    assert np.allclose(best, exact) and seen < 0.2 * leaves
    rough, fewer = found(0.2)
    assert (rough <= exact + 1e-12).all() and fewer < seen


def _leaves(node):
    if len(node) == 1:
        yield node
    else:
        yield from _leaves(node[2])
        yield from _leaves(node[3])


def test_license_digest(spark):
    from corvane.llm.license_texts import LICENSES

    name, text = LICENSES[0]
    rows = [(1, text, "en", "a"), (2, text.upper().replace("\n", "\n\n  "), "en", "a"), (3, text.replace("Copyright (c) <year> <copyright holders>", "(c) 1999 Someone Else, Inc."), "en", "a"), (4, text + " more", "en", "a"), (5, None, "en", "a"), (6, "", "en", "a")]
    got = {r["doc_id"]: (r["license_id"], r["is_license"]) for r in licenses.scan_licenses(docs_of(spark, rows)).collect()}
    assert got == {1: (name, True), 2: (name, True), 3: (name, True), 4: (None, False), 5: (None, False), 6: (None, False)}


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/x", "https://www.example.com/en/", "http://a.net/es/q?x#y", "ftp://net/fr/", "http://shop.org/cart/1", "nothing", None, "://", "http://notexample.com/en/", "http://x.org?://a.net/es/", "http://shop.org/scart/1", "http://net/es"]
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(spark.createDataFrame([(u, "h") for u in urls], "url string, host string")).collect()}
    assert got == {
        urls[0]: ("example.com", "/en/x", "example.com/en/", "block"), urls[1]: ("www.example.com", "/en/", "www.example.com/en/", "allow"), urls[2]: ("a.net", "/es/q", "net/es/", "block"),
        urls[3]: ("net", "/fr/", "net/fr/", "block"), urls[4]: ("shop.org", "/cart/1", None, "block"), urls[5]: ("", "", None, "allow"), None: ("", "", None, "allow"), urls[7]: ("", "", None, "allow"),
        urls[8]: ("notexample.com", "/en/", "com/", "allow"), urls[9]: ("x.org", "", None, "allow"), urls[10]: ("shop.org", "/scart/1", None, "allow"), urls[11]: ("net", "/es", None, "allow"),
    }


def test_url_separators_and_labels(spark):
    blocked = ["http://a.org/casino/", "http://a.org/x?casino", "http://casino.a.org/x", "http://www.Casino.com", "http://a.org/wp-login.php?x=1", "http://a.org/i.jpg", "http://payday-loans.a.org/", "http://a.org/login"]
    allowed = ["http://a.org/essay-on-casino-history", "http://a.org/casino.html", "http://mycasino.org/", "http://a.org/x/casino_1", "http://a.org/i.jpg.html", "http://a.casino/", "http://a.org/login-help", "http://a.org/100%casino%20"]
    urls = spark.createDataFrame([(u,) for u in blocked + allowed], "url string")
    got = {r["url"]: r["verdict"] for r in url_filter.filter_urls(urls).collect()}
    assert got == dict.fromkeys(blocked, "block") | dict.fromkeys(allowed, "allow")
    assert url_filter.filter_urls(urls.limit(0)).count() == 0


def test_quality_held_out(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.classify(docs, labels.where("doc_id % 3 != 0"))
    right = got.join(labels.where("doc_id % 3 = 0"), "doc_id").selectExpr("avg(cast(kept = (quality = 1) as int)) a", "avg(case when quality = 1 then cast(kept as int) end) g").first()
    assert right["a"] >= 0.95 and right["g"] >= 0.97


def test_quality_posteriors_against_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(i, f"h{i % 4 if i % 7 else 0}", f"p{i % 3}", float(rng.random() < (0.3 + 0.15 * (i % 4))), float(rng.normal())) for i in range(200)] + [(900, "lone", "p", 1.0, 0.5)]
    got = {r["doc_id"]: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, y double, evidence double")).collect()}
    hosts, paths = collections.defaultdict(list), collections.defaultdict(list)
    for _, h, p, y, _ in rows:
        hosts[h].append(y), paths[h, p].append(y)
    rate = (sum(r[3] for r in rows) + 0.5) / (len(rows) + 1)

    def strength(groups, mean):
        use = [(len(g), sum(g) / len(g), mean(k)) for k, g in groups.items() if len(g) > 1]
        spread, chance, whole = sum(n * (r - p) ** 2 for n, r, p in use), sum(p * (1 - p) for n, r, p in use), sum(n * p * (1 - p) for n, r, p in use)
        over = (spread - chance) / (whole - chance)
        return 1e6 if over <= 1e-6 else min(max(1 / over - 1, 1.0), 1e6)

    hm = strength(hosts, lambda h: rate)
    post = {h: (sum(g) + hm * rate) / (len(g) + hm) for h, g in hosts.items()}
    pm = strength(paths, lambda k: post[k[0]])
    for i, h, p, y, e in rows:
        hp = (sum(hosts[h]) - y + hm * rate) / (len(hosts[h]) - 1 + hm)
        pp = (sum(paths[h, p]) - y + pm * hp) / (len(paths[h, p]) - 1 + pm)
        assert got[i]["host_posterior"] == pytest.approx(hp) and got[i]["path_posterior"] == pytest.approx(pp)
        assert got[i]["score"] == pytest.approx(1 / (1 + math.exp(-(e + math.log(pp / (1 - pp))))))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = langid.predict(docs, langid.train(docs)).where(langid.held_out())
    assert found.selectExpr("avg(cast(lang_pred = lang as int))").first()[0] >= 0.97
    # The text alone decides.
    model = langid.train(docs)
    other = docs.selectExpr("doc_id + 1 as doc_id", "text", "'zz' as lang", "'q' as source")
    same = langid.predict(docs, model).select("text", "lang_pred").exceptAll(langid.predict(other, model).select("text", "lang_pred"))
    assert same.count() == 0


def test_language_odd(odd, spark):
    model = langid.train(odd)
    got = langid.predict(odd, model)
    assert got.columns == [*odd.columns, "lang_pred", "score"]
    assert {(r["text"] or "")[:4]: r["lang_pred"] for r in got.collect() if r["doc_id"] in (1, 2, 5)} == {"": "und", "123 ": "und"}
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    none = langid.train(odd.limit(0))
    assert {r["lang_pred"] for r in langid.predict(odd, none).collect()} == {"und"}
    assert langid.held_out().__class__ and langid.family("en-GB") == langid.family("de") != langid.family("fr") and langid.family("xx") == "xx"


def test_mixing_weights(spark):
    rows = [(i, "w " * (5 + i % 7), "en", "big" if i % 10 < 8 else "mid" if i % 10 < 9 else "small") for i in range(3000)]
    docs = docs_of(spark, rows)
    out = mixing.mix(docs, entropy=0.9, repeats=3.0, block_tokens=200)
    total = sum(5 + i % 7 for i in range(3000))
    got = {r["source"]: r["t"] for r in out.groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    own = collections.Counter()
    for i, t, _, s in rows:
        own[s] += len(t.split())

    def entropy(a):
        w = np.array([(own[s] / total) ** a for s in own])
        w /= w.sum()
        return -(w * np.log(w)).sum() / math.log(len(own)), max(w[k] * total / own[s] for k, s in enumerate(own)), dict(zip(own, w))

    grid = np.linspace(0, 1, 20001)
    a = max(max(x for x in grid if entropy(x)[0] >= 0.9), min(x for x in grid if entropy(x)[1] <= 3.0))
    weights = entropy(a)[2]
    for s in own:
        assert weights[s] * total - 30 <= got[s] <= weights[s] * total + 30, s
    # Whole epochs show all, none shows a document twice, and every prefix by `at` has about the weights.
    per = out.groupBy("doc_id", "epoch").count()
    assert per.where("count > 1").count() == 0
    half = {r["source"]: r["t"] for r in out.where("at < 0.5").groupBy("source").agg({"n_tokens": "sum"}).withColumnRenamed("sum(n_tokens)", "t").collect()}
    assert half["big"] / sum(half.values()) == pytest.approx(weights["big"], abs=0.08)


def test_mixing_odd(odd, spark):
    out = mixing.mix(odd, block_tokens=10)
    assert out.columns == [*odd.columns, "n_tokens", "epoch", "block", "at"]
    assert out.where("n_tokens > 0").count() and mixing.mix(odd.limit(0)).count() == 0
    assert mixing.mix(odd.where("doc_id = 1")).count() == 0


def plain_best_fit(sizes, sources, clusters, capacity):
    bins, out = [], []
    for z, s, c in zip(sizes, sources, clusters):
        fit = [(capacity - b["used"], k) for k, b in enumerate(bins) if b["used"] < capacity and capacity - b["used"] >= z and s not in b["s"] - {-1} and c not in b["c"] - {-1}]
        if fit:
            k = min(fit)[1]
        else:
            bins.append({"used": 0, "s": set(), "c": set()})
            k = len(bins) - 1
        bins[k]["used"] += z
        bins[k]["s"].add(s), bins[k]["c"].add(c)
        out.append(k)
    return out


def test_best_fit_against_scan():
    rng = np.random.default_rng(2)
    for _ in range(20):
        n = 150
        sizes = sorted(rng.integers(0, 60, n).tolist(), reverse=True)
        sources, clusters = np.minimum(rng.integers(-1, 12, n), 8).tolist(), rng.integers(-1, 60, n).tolist()
        assert packing.best_fit(sizes, sources, clusters, 100) == plain_best_fit(sizes, sources, clusters, 100)


def test_packing_keeps_all(odd, corpus, spark):
    rows = corpus.selectExpr("doc_id", "source", "cast(n_chars as long) n_tokens", "cast(hash(text) as string) cluster", "'x' as shard")
    rows = rows.unionByName(rows.limit(20)).unionByName(spark.createDataFrame([(None, None, None, None, "y"), (7, "src1", -5, None, "y")], "doc_id long, source string, n_tokens long, cluster string, shard string"))
    out = packing.pack(rows, capacity=512, shard=64)
    assert out.selectExpr("sum(n_tokens)").first()[0] == rows.where("n_tokens > 0").selectExpr("sum(n_tokens)").first()[0]
    bins = out.groupBy("bin_id").agg({"n_tokens": "sum", "bin_tokens": "max", "slot": "max", "*": "count"})
    assert bins.where("`sum(n_tokens)` != `max(bin_tokens)` or `sum(n_tokens)` > 512 or `max(slot)` + 1 != `count(1)`").count() == 0
    conflict = out.join(rows.select("doc_id", "source", "cluster").distinct(), "doc_id").groupBy("bin_id", "source").count().where("count > 1 and source is not null")
    assert conflict.count() == 0
    assert packing.pack(rows.limit(0)).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = common.stored(stage(spark, seen, SF), name)
        assert seen.columns == docs.columns and seen.count() > 0, name
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "mixing", "packing"]


def test_odd_rows_everywhere(odd, spark):
    labels = spark.createDataFrame([(3, 1), (3, 0), (None, 1), (4, 1), (1, 0)], "doc_id long, quality int")
    for df in (odd, odd.limit(0)):
        n = df.count()
        assert line_dedup.drop_lines(df).count() == n and licenses.scan_licenses(df).count() == n
        assert simhash.near_duplicates(df).count() == n and quality.classify(df, labels).count() == n
        assert simhash.one_of_each(df).columns == df.columns


@pytest.mark.parametrize("name", ["op1_line_dedup", "op2_embedding_dedup", "op3_license_scan", "op5_vptree_search", "op6_url_filter", "op8_mixing"])
def test_parity(spark, name):
    sys.path.insert(0, "/root/repo/tests")
    import parity
    from corvane.llm import entries

    assert parity.compare(spark, entries.QUERIES[name], entries.ORACLES[name], SF) > 0
