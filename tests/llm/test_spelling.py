"""Spelling variants: the trie self-join against all pairs, and the whole query against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from corvane.llm import spelling

DOCS = "doc_id long, text string"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def all_pairs(words):
    words = sorted(words, key=lambda w: (len(w), w))
    return sorted(tuple(sorted((a, b))) for i, a in enumerate(words) for b in words[i + 1 :] if len(b) - len(a) < 2 and near(a, b))


def plain_words(docs, noise=31, least=7, count=2):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= least
    return {w: k for w, k in n.items() if k >= count}


def plain(words, ratio=10):
    out, form = [], {}
    near_of = {w: [v for v in words if abs(len(v) - len(w)) < 2 and near(w, v)] for w in words}
    for w, others in near_of.items():
        if others and words[best := min(others, key=lambda v: (-words[v], v))] >= ratio * words[w]:
            form[w] = best
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, len(near_of[w]), words[form[w]] if w in form else None))
    return sorted(out)


def rows(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


@pytest.mark.parametrize("seed", range(20))
def test_the_trie_finds_all_pairs_once(seed):
    r = random.Random(seed)
    words = list({"".join(r.choice("abÿ"[: 2 + seed % 2]) for _ in range(r.randrange(0, 9))) for _ in range(80)})
    got = [tuple(sorted((words[i], words[j]))) for i, j in spelling.pairs(words)]
    assert sorted(got) == all_pairs(words)


@pytest.mark.parametrize("part", [1, 3, 20, 1000])
def test_parts_find_all_pairs_once(spark, part):
    r = random.Random(part)
    words = {"".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(250)} | {"same" + "".join(r.choice("xyé") for _ in range(4)) + "end" for _ in range(60)}
    n = {w: r.randrange(1, 2000) for w in words}
    found = spelling.near_pairs(spark.createDataFrame(list(n.items()), "word string, n long"), part).collect()
    assert sorted(tuple(sorted((x["a"], x["b"]))) for x in found) == all_pairs(words)
    assert all(len(x["a"]) <= len(x["b"]) and (x["a_n"], x["b_n"]) == (n[x["a"]], n[x["b"]]) for x in found)


def test_whole_query_against_plain_python(spark):
    r = random.Random(9)
    stems = ["spelling", "Variants", "gróupings", "÷symbols×", "partition", "particion", "ÀÉÎtrees"]
    docs = [(i, " ".join(r.choice(stems) + r.choice(["", "", "", "s", "S-", "1", ".", "'"]) for _ in range(150))) for i in range(60)]
    docs += [(None, "spelling spellings"), (7, None), (8, ""), (9, "x" * 5000), (9, "x" * 5000), (10, docs[3][1]), (3, docs[3][1])]
    frame = spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as word", "2 as n", "3 as run", "4 as d")
    want = plain(plain_words(docs))
    assert rows(spelling.spelling_variants(frame)) == want
    assert any(x[1] for x in want) and any(x[4] > 1 for x in want)


def test_chains_ties_and_repeats(spark):
    words = [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("ccccccc", 5), ("cccccca", 50), ("ccccccb", 50), ("zzzzzzz", 3), ("zzzzzzy", 29), ("aaaaaaa", 1), ("aaaaaaa", None), (None, 5)]
    got = {x[0]: x[1:] for x in rows(spelling.variants(spark.createDataFrame(words, "word string, n long")))}
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 1, 1, 10)
    assert got["ccccccc"][:2] == ("cccccca", "cccccca") and got["zzzzzzz"] == (None, "zzzzzzz", 3, 1, None)
    assert len(got) == 9
    assert rows(spelling.variants(spark.createDataFrame([], "word string, n long"))) == []
    assert rows(spelling.spelling_variants(spark.createDataFrame([], DOCS))) == []


def test_a_prefix_of_a_third_of_all_words(spark):
    words = {f"{'prefix'}{a}{b}{c}" for a in "abcdefghijk" for b in "abcdefghijk" for c in "abcdefghijk"}
    found = spelling.near_pairs(spark.createDataFrame([(w, 1) for w in words], "word string, n long"), 100)
    assert found.count() == 11 * 11 * 55 * 3
