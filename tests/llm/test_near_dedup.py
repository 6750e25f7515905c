"""The pipeline's near-dedup against all pairs of five-word shingle sets."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import near_dedup
from corvane.session import stored


def shingle_set(text):
    words = tuple((text or "").lower().split())
    return {words[i : i + 5] for i in range(max(1, len(words) - 4))} if words else set()


def plain_groups(texts):
    """The smallest id of each text's group: all pairs, then components."""
    sets, up = {i: shingle_set(x) for i, x in texts.items()}, {i: i for i in texts}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(texts), 2):
        common = len(sets[a] & sets[b])
        if not sets[a] | sets[b] or common / max(1, len(sets[a]) + len(sets[b]) - common) >= 0.8:
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def texts():
    """Near copies of one to nine changed words, of which some link only by others, exact copies and short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    out = []
    for _ in range(12):
        base = [word() for _ in range(200)]
        out.append(" ".join(base))
        for n in range(1, 10):
            copy = list(base)
            for i in rng.sample(range(200), n):
                copy[i] = word()
            out.append(" ".join(copy).upper() if n % 2 else "\n".join(copy))
    out += [out[0], "one two", "One  two", "one two three four five", "one two three four six", "", " ", None]
    return dict(enumerate(out))


def test_groups_against_all_pairs(spark, texts):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    root = {r["doc_id"]: r["root"] for r in near_dedup.grouped(docs).collect()}
    least = {}
    for i in sorted(root):
        least.setdefault(root[i], i)
    assert {i: least[root[i]] for i in root} == plain_groups(texts)


def test_pipeline_drops_near_copies(spark, texts):
    docs = spark.createDataFrame([(i, x, "en", "s", len(x or "")) for i, x in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()}
    assert kept == set(plain_groups(texts).values())


def test_buckets_of_unlike_texts_are_compared_whole(spark):
    """Pairs that share a bucket with smaller keys unlike them are found, also where each lead is unlike them."""
    base = [[f"g{g}w{i}" for i in range(60)] for g in range(9)]
    rows = [(g * 2 + k, " ".join(b + ["x", "y"][k : k + 1])) for g, b in enumerate(base) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = stored(near_dedup._keyed(docs, "text").withColumns({"buckets": F.array(F.lit(1).cast("long")), "fp": F.col("key")}), "found")
    for block, listed in ((near_dedup.BLOCK, near_dedup.LISTED), (4, near_dedup.LISTED), (4, -1)):
        _check_links(found, near_dedup.links(docs, found, "text", block=block, listed=listed).collect())


def _check_links(found, linked):
    of = {r["key"]: r["doc_id"] // 2 for r in found.collect()}
    assert {of[r["a"]] for r in linked} == set(range(9)) and all(of[r["a"]] == of[r["b"]] for r in linked)


def test_similar_sets_by_products():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 300, 60)
    sets = [np.unique(np.where(rng.random(60) < rng.uniform(0, 0.3), rng.integers(0, 9000, 60), base)) for _ in range(80)] + [np.array([7]), np.array([9000])]
    want = [[len(set(a) & set(b)) / len(set(a) | set(b)) >= 0.8 for b in sets] for a in sets]
    assert near_dedup.similar(sets).tolist() == want
