"""Spelling variants of a corpus's own words, by a trie self-join with active-node sets."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import discard, few, stored

#: Code points and occurrences that a word needs, and how many times as frequent the form of a word is at least.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence in so many is misspelt by the noise of `noisy`.
NOISE = 31
#: Words of a part of the trie beyond which it is parted further.
PART = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """The maximal runs of letters of a text, A-Z lower-cased, that have `least` code points or more."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(f"[a-z\\u00C0-\\u00FF]{{{least},}}"), F.lit(0))


def noisy(doc_id: Column, run: Column, noise: int = NOISE) -> Column:
    """`run` without one code point where `noise` divides the crc32 of "<doc_id>:<run>", which says which one."""
    h = F.crc32(F.encode(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run), "utf-8"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))
    return F.when(h % noise == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of whole texts and their occurrences. Counts are partial sums, so no word is hot."""
    found = docs.select(F.col(doc_id).alias("d"), F.explode(runs(F.col(text), least_length)).alias("run"))
    words = found.select(noisy(F.col("d"), F.col("run"), noise).alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


class Node:
    """A node of a trie: children by code point, depth, and the word that ends here, if any."""

    __slots__ = ("children", "depth", "word")

    def __init__(self, depth: int):
        self.children, self.depth, self.word = {}, depth, None


def trie(words: list[str]) -> Node:
    """The trie of different words; `word` of a terminal node is the word's place in the list."""
    root = Node(0)
    for at, word in enumerate(words):
        node = root
        for c in word:
            below = node.children.get(c)
            if below is None:
                below = node.children[c] = Node(node.depth + 1)
            node = below
        node.word = at
    return root


def pairs(words: list[str]) -> Iterator[tuple[int, int]]:
    """The places (i, j) of each pair of different words at edit distance one, once: the shorter or earlier first.

    Each node has the active nodes at distance one (at distance zero is itself alone), and they follow from its parent's
    on the way down: the child's siblings (a code point replaced), the child's own children (one inserted after it), and
    what the parent's active nodes have under the same code point. The parent itself (one deleted) is left out, as
    its words are the shorter ones and find the pair from their side. Active terminal nodes of a terminal node are its
    pairs.
    """
    root = trie(words)
    stack = [(root, set(root.children.values()))]
    while stack:
        node, active = stack.pop()
        if node.word is not None:
            for other in active:
                if other.word is not None and (other.depth > node.depth or node.word < other.word):
                    yield node.word, other.word
        for c, child in node.children.items():
            on = {x.children[c] for x in active if c in x.children}
            on.update(child.children.values())
            on.update(x for x in node.children.values() if x is not child)
            stack.append((child, on))


def near_pairs(words: DataFrame, part: int = PART) -> DataFrame:
    """(a, b, a_n, b_n): each pair of `words` (word, n; words different) at edit distance one, once; a is not longer.

    The trie is partitioned by prefixes. A part of size class m has words of m or m + 1 code points with both ends in
    common, and its trie is over what is between. One edit leaves the first half of m or the last half alone, so a word
    goes to the part of its first half and to that of its last half, in its own class and in the one below, and each
    pair at distance one meets. A part of over `part` words is parted again by the halves of what is between, until that
    is one code point: such a part is bounded by the alphabet. So no part is a large task, however many words have
    one prefix, and no word is copied to more parts than its length has halvings.
    """
    size, between = F.char_length("word"), F.col("m") - F.col("lo") - F.col("hi")
    by = ["m", "lo", "hi", "unlike", "front", "back"]
    todo = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where("m > 0")
    # `unlike`: pairs that have so many first code points in common are found in another part.
    todo = todo.selectExpr("word", "n", "m", "0 as lo", "0 as hi", "m + 1 as unlike")
    tables, found = [], []
    while True:
        half = F.floor(between / 2).cast("int")
        first = F.struct((F.col("lo") + half).alias("lo"), F.col("hi").alias("hi"), F.col("unlike").alias("unlike"))
        last = F.struct(F.col("lo").alias("lo"), (F.col("m") - F.col("lo") - half).alias("hi"), (F.col("lo") + half).alias("unlike"))
        parts = todo.select("word", "n", "m", F.explode(F.array(first, last)).alias("p")).select("word", "n", "m", "p.*")
        ends = F.substring("word", F.lit(1), F.col("lo")), F.substring("word", size - F.col("hi") + 1, F.col("hi"))
        parts = stored(parts.select("*", ends[0].alias("front"), ends[1].alias("back")), "parts")
        hot = stored(parts.where(between > 1).groupBy(*by).agg(F.count("*").alias("rows")).where(F.col("rows") > part).drop("rows"), "hot")
        several = parts.join(few(hot), by, "left_anti").groupBy(*by).agg(F.collect_list(F.struct("word", "n")).alias("words")).where(F.size("words") > 1)
        found.append(stored(several.select("m", "lo", "hi", "unlike", "words").mapInArrow(_joined, "a string, b string, a_n long, b_n long"), "pairs"))
        tables += [parts, hot]
        if hot.isEmpty():
            discard(*tables)
            return reduce(DataFrame.unionByName, found)
        todo = parts.join(few(hot), by, "left_semi").select("word", "n", "m", "lo", "hi", "unlike")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(batch.num_rows):
            m, lo, hi, unlike, listed = (batch.column(c)[at].as_py() for c in range(5))
            words, out = [x["word"] for x in listed], []
            for i, j in pairs([w[lo : len(w) - hi] for w in words]):
                one, other = words[i], words[j]
                if len(one) == m and one[:unlike] != other[:unlike]:
                    out.append((one, other, listed[i]["n"], listed[j]["n"]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["a", "b", "a_n", "b_n"])


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) lead to at last. Each round doubles the steps behind a row, so there
    are few: occurrences grow along a chain by a ratio at least."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if now.join(few(onward), "root", "left_semi").isEmpty():
            return now
        last, now = now, stored(now.join(few(onward), "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
        discard(last)


def variants(words: DataFrame, ratio: int = RATIO, part: int = PART) -> DataFrame:
    """(word, form, root, n, n_near, form_n): a row for each of `words` (word, n).

    Two words are near at edit distance one: a code point inserted, deleted or replaced. A word's form is the most
    frequent near word (of equal ones the first in the order of code points) if that occurs `ratio` times as often at
    least; root is where forms lead to, the word itself where it has none; n_near counts near words. Rows that repeat a
    word are one, of the largest n; a null word or n takes no part; an empty table gives an empty table.
    """
    words = stored(words.where("word is not null and n is not null").groupBy("word").agg(F.max("n").alias("n")), "words")
    pairs = near_pairs(words, part)
    both = pairs.selectExpr("a as word", "b as near", "b_n as m").unionByName(pairs.selectExpr("b as word", "a as near", "a_n as m"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    formed = -F.col("best.m") >= F.lit(ratio) * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.m")).alias("form_n"))
    found = stored(found, "found")
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(few(ends), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", noise: int = NOISE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO) -> DataFrame:
    """`variants` of the `vocabulary` of `docs`. Null and empty texts have no words; a null doc_id is an empty one in the
    noise; repeated rows count as often as they stand; other columns are ignored."""
    return variants(vocabulary(docs, doc_id, text, noise, least_length, least_count), ratio)
