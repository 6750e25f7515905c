"""Benchmark decontamination against a search of every window of every text."""

import random
import re

import numpy as np
import pytest

from corvane.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, span=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(span, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if (here := tuple(w[a : a + n])) in windows:
                    hit |= set(range(a, a + n))
                    found |= {str(x) for x in windows[here] if x is not None}
        out.append((doc, len(w), len(hit), sorted(found), bool(hit)))
    return sorted(out, key=repr)


def ours(spark, docs, items, more=False):
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    if more:
        d, i = d.selectExpr("*", "1 as words", "2 as fp", "3 as n", "4 as key", "5 as item_id"), i.selectExpr("*", "1 as item", "2 as t", "3 as doc_id")
    found = decontaminate.contamination(d, i).collect()
    for r in found:
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_hit"]
        assert all(a["end"] < b["begin"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted([(r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in found], key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_against_every_window(spark, seed):
    r = random.Random(seed)
    few = ["a", "B", "cé", "Dd"]

    def text(n):
        return r.choice([" ", ", ", "\n"]).join(r.choice(few) if r.random() < 0.9 else r.choice(["e1", "Ñ", "_", "'", "9", "漢字"]) for _ in range(n))

    least = [0, 1, 4][seed]
    items = [(i, text(r.choice([0, *range(least, 16)] if least else [0, 8, 9, 10, 11, 14]))) for i in range(40)]
    items += [(3, text(12)), (None, text(12)), (99, None), (100, "")]
    docs = [(i, text(r.choice([0, 3, 9, 10, 30, 200]))) for i in range(200)] + [(None, text(50)), (5, None), (5, ""), (7, items[4][1]), (8, items[41][1])] * 2
    assert ours(spark, docs, items) == plain(docs, items)


def test_passages_of_other_words_case_and_marks(spark):
    item = "One two, three four five six seven eight nine ten eleven"
    docs = [
        (1, "x " + item.upper().replace(",", ";\n--") + " y"),
        (2, "One two three four five six seven eight nine"),
        (3, "zero two three four five six seven eight nine ten eleven twelve"),
        (4, "one two three four five SIX6 seven eight nine ten eleven"),
        (5, ("one two three four five six seven eight nine ten " * 3).strip()),
    ]
    got = {r[0]: r[2] for r in ours(spark, docs, [(1, item)], more=True)}
    assert got == {1: 11, 2: 0, 3: 10, 4: 0, 5: 30}
    assert ours(spark, docs, [(1, item)]) == plain(docs, [(1, item)])


def test_empty_tables(spark):
    docs = [(1, "a b c"), (2, None)]
    assert ours(spark, docs, []) == [(1, 3, 0, [], False), (2, 0, 0, [], False)]
    assert ours(spark, [], [(1, "a b c")]) == []
    assert ours(spark, docs, [(1, None)]) == [(1, 3, 0, [], False), (2, 0, 0, [], False)]


def test_a_very_long_text_and_many_copies(spark):
    r = random.Random(5)
    item = " ".join(f"q{r.randrange(50)}" for _ in range(40))
    long = " ".join(f"w{r.randrange(3000)}" for _ in range(200_000)) + " " + item
    docs = [(0, long)] + [(i, f"lead {item} tail") for i in range(1, 3001)]
    items = [(i, f"{item} {i}") for i in range(300)]
    got = ours(spark, docs, items)
    assert len(got) == 3001 and all(x[2] == 40 and len(x[3]) == 300 for x in got)


@pytest.mark.parametrize("span", range(1, 11))
def test_a_shared_span_has_a_common_fingerprint(span):
    r, powers = random.Random(span), decontaminate.Powers()
    for _ in range(50):
        shared = [f"s{r.randrange(4)}" for _ in range(span)]
        texts = [" ".join([f"{side}{r.randrange(9)}" for _ in range(r.randrange(20))] + shared + [f"{side}{r.randrange(9)}" for _ in range(r.randrange(20))]).encode() for side in "ab"]
        one, two = (set(decontaminate.Words([t], powers).winnow(span)[1].tolist()) for t in texts)
        assert one & two
    k, w = decontaminate.gram(span)
    assert k + w - 1 == span


def test_texts_of_a_chunk_do_not_touch():
    powers = decontaminate.Powers()
    together = decontaminate.Words([b"a b c", b"", b"d e f g"], powers)
    assert together.counts.tolist() == [3, 0, 4]
    at, fp = together.winnow(3)
    alone = np.concatenate([decontaminate.Words([t], powers).winnow(3)[1] for t in (b"a b c", b"d e f g")])
    assert together.of[at].tolist() == [0, 2, 2] and (fp == alone).all()
    assert together.spell(at, 3) == ["a b c", "d e f", "e f g"]
