"""Benchmark decontamination by winnowing: which words of a document stand in a passage that a benchmark item has too."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import few, small_batches, stored

#: Words of a window: shared spans of so many are found. A shorter item is one window of all its words.
SPAN = 10
#: Bytes of texts that are hashed at once (a longer text alone is more), and bits of the filter of benchmark fingerprints.
CHUNK, FILTER_BITS = 1 << 18, 26
#: Word bytes as they count: A-Z as a-z, digits, and all bytes of characters beyond ASCII; zero for the others.
_LOW = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Odd multipliers of the polynomial hashes of bytes and of words.
_BYTES, _WORDS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
_ROW = "at: int, fp: long, n: int, words: string"


def gram(span: int) -> tuple[int, int]:
    """(words of a gram, grams of a window) that guarantee a common fingerprint to any shared span of `span` words."""
    k = (span + 1) // 2
    return k, span - k + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the byte multiplier and of its inverse, as many as the longest chunk so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size, inverse = max(n, 2 * len(self.up)), np.uint64(pow(int(_BYTES), -1, 1 << 64))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BYTES, inverse))
        return self.up, self.down


class Words:
    """The words of some texts, their hashes, and the text that each stands in."""

    def __init__(self, texts: list[bytes], powers: Powers):
        low = _LOW[np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)]
        inside = low != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        self.low, self.inside, self.starts, self.ends = low, inside, edge[::2], edge[1::2]
        first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        self.of = np.searchsorted(first, self.starts, "right") - 1
        self.counts = np.bincount(self.of, minlength=len(texts))
        self.begin = np.concatenate([[0], np.cumsum(self.counts)])
        up, down = powers.upto(len(low))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(low * up[: len(low)])])
        self.hashes = _mixed((total[self.ends] - total[self.starts]) * down[self.starts])

    def winnow(self, span: int) -> tuple[np.ndarray, np.ndarray]:
        """(word that a window begins at, its fingerprint): of each window of `span` words the least hash of its grams."""
        k, w = gram(span)
        if len(self.hashes) < span:
            return np.zeros(0, int), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.of[: len(self.of) - span + 1] == self.of[span - 1 :])
        grams = self.hashes[: len(self.hashes) - k + 1]
        for j in range(1, k):
            grams = grams * _WORDS + self.hashes[j : len(self.hashes) - k + 1 + j]
        grams = _mixed(grams)
        least = grams[: len(grams) - w + 1]
        for j in range(1, w):
            least = np.minimum(least, grams[j : len(grams) - w + 1 + j])
        return at, least[at]

    def spell(self, at: np.ndarray, span: int) -> list[str]:
        """The lower-cased words of windows, each followed by one blank but the last."""
        kept = self.inside.copy()
        kept[self.ends] = True
        place = np.cumsum(kept) - 1
        plain = np.where(self.inside, self.low, 32).astype(np.uint8)[kept].tobytes()
        return [plain[a:b].decode() for a, b in zip(place[self.starts[at]].tolist(), place[self.ends[at + span - 1]].tolist())]


def _chunks(texts: pa.Array) -> Iterator[list[bytes]]:
    """The texts as UTF-8, null as empty, a few at a time."""
    out, held = [], 0
    for x in texts.cast(pa.large_binary()):
        out.append(x.as_py() or b"")
        held += len(out[-1])
        if held >= CHUNK:
            yield out
            out, held = [], 0
    if out:
        yield out


def _windows(spans: list[int], known: np.ndarray | None, whole: bool = False) -> Callable[[Column], Column]:
    """A function of a text column: (n_words, key, windows). Windows are those whose fingerprint may be in `known`, a
    bitmap of the high bits (None: all), each with its first word, fingerprint, size and words; of sizes below SPAN, an
    item has one only where it has just so many words (`whole`). key is a digest of the windows, null where there is none."""

    def run(texts: pa.Array) -> pa.Array:
        powers, rows = Powers(), []
        for chunk in _chunks(texts):
            words, found = Words(chunk, powers), [[] for _ in chunk]
            for span in spans:
                at, fp = words.winnow(span)
                good = np.ones(len(at), bool)
                if known is not None:
                    high = fp >> np.uint64(64 - FILTER_BITS)
                    good &= (known[(high >> np.uint64(6)).astype(int)] >> (high & np.uint64(63)) & np.uint64(1)).astype(bool)
                if whole and span < SPAN:
                    good &= words.counts[words.of[at]] == span
                at, fp = at[good], fp[good]
                if len(at):
                    of = words.of[at]
                    for i, place, f, text in zip(of.tolist(), (at - words.begin[of]).tolist(), fp.view(np.int64).tolist(), words.spell(at, span)):
                        found[i].append({"at": place, "fp": f, "n": span, "words": text})
            for n, windows in zip(words.counts.tolist(), found):
                key = hashlib.sha256("\n".join(f"{x['at']} {x['n']} {x['words']}" for x in windows).encode()).hexdigest() if windows else None
                rows.append({"n_words": n, "key": key, "windows": windows})
        return pa.array(rows, pa.struct([("n_words", pa.int64()), ("key", pa.string()), ("windows", pa.list_(pa.struct([("at", pa.int32()), ("fp", pa.int64()), ("n", pa.int32()), ("words", pa.string())])))]))

    return F.arrow_udf(run, f"n_words long, key string, windows array<struct<{_ROW}>>").asNondeterministic()


def _bitmap(fps: DataFrame) -> np.ndarray:
    """The fingerprints' high bits as a bitmap: 2 ** FILTER_BITS bits whatever the benchmark's size, gathered by words."""
    high = F.shiftrightunsigned("fp", 64 - FILTER_BITS)
    found = fps.groupBy(F.shiftright(high, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - FILTER_BITS}) & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, contaminated): a row for each row of `docs`.

    Words are runs of digits, letters and characters beyond ASCII, A-Z lower-cased. A window is SPAN consecutive words
    of an item, or all words of an item of fewer; n_hit counts the document's words inside an occurrence of any window,
    spans has their stretches as (begin, end) word numbers, end excluded, and items the ids, as sorted strings, of the
    items with such windows. A null or empty text has no words; a null item_id hits words and is no item; repeated rows
    stay, and rows of one item_id are one item. Empty tables, extra columns and texts of any length are allowed.

    Winnowing: each window of a text has the least hash of its grams of half as many words as fingerprint, so a window
    that a document shares with an item has the same one in both. Documents are read once: tasks keep the windows whose
    fingerprint passes a bitmap of the benchmark's, of a fixed size, and these hits are extended to the window's whole
    words, which are joined by fingerprint and words with the benchmark's distinct windows. Windows of one set of items
    are one class, and documents of the same windows are settled once, so copies and passages in many items multiply
    nothing.
    """
    sized = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("t"))
    every = list(range(1, SPAN + 1))
    ours = sized.select("item", F.explode(_windows(every, None, whole=True)(F.col("t"))["windows"]).alias("w")).select("item", "w.fp", "w.n", "w.words").distinct()
    ours = stored(ours, "benchmark")
    # A window's class: two sums over its items, the same for windows of the same items.
    name = F.coalesce("item", F.lit(""))
    classed = ours.groupBy("fp", "n", "words").agg(F.bit_xor(F.xxhash64(F.lit(1), "item")).alias("x"), F.bit_xor(F.xxhash64(F.lit(2), name, F.lit(3))).alias("y"))
    classed = stored(classed, "classes")
    shown = classed.groupBy("x", "y").agg(F.min(F.struct("fp", "n", "words")).alias("w")).select("x", "y", "w.*")
    members = stored(ours.join(shown, ["fp", "n", "words"]).where("item is not null").select("x", "y", "item"), "members")
    spans = sorted(r["n"] for r in classed.select("n").distinct().collect())
    read = _windows(spans, _bitmap(classed))(F.col(text))
    with small_batches(docs.sparkSession):
        found = stored(docs.select(F.col(doc_id).alias("doc_id"), read.alias("f")).select("doc_id", "f.*"), "windows")

    hits = found.where("key is not null").select("key", F.explode("windows").alias("w")).select("key", "w.*").distinct()
    hits = stored(hits.join(few(classed), ["fp", "n", "words"]).select("key", "at", "n", "x", "y"), "hits")
    # Stretches: a window that begins beyond the end of all before it begins one.
    ahead = W.partitionBy("key").orderBy("at", "n")
    marked = hits.select("key", "at", (F.col("at") + F.col("n")).alias("end"), "n").distinct()
    marked = marked.withColumn("upto", F.max("end").over(ahead.rowsBetween(W.unboundedPreceding, -1)))
    marked = marked.withColumn("stretch", F.sum(F.when(F.col("at") <= F.col("upto"), 0).otherwise(1)).over(ahead))
    whole = marked.groupBy("key", "stretch").agg(F.min("at").alias("begin"), F.max("end").alias("end"))
    whole = whole.groupBy("key").agg(F.sum(F.col("end") - F.col("begin")).alias("n_hit"), F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    sets = hits.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("classes"))
    sets = stored(sets.withColumn("set", F.sha2(F.to_json(F.struct("classes")), 256)), "sets")
    listed = sets.groupBy("set").agg(F.first("classes").alias("classes")).select("set", F.explode("classes").alias("c")).select("set", "c.*")
    listed = listed.join(members, ["x", "y"]).groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    settled = stored(whole.join(sets.select("key", "set"), "key").join(listed, "set", "left").drop("set"), "settled")

    none = F.array().cast("array<string>")
    hot = found.where("key is not null").select("doc_id", "n_words", "key").join(few(settled), "key", "left")
    hot = hot.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"), F.coalesce("spans", F.array().cast("array<struct<begin:int,end:int>>")).alias("spans"))
    clean = found.where("key is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_hit"), none.alias("items"), F.array().cast("array<struct<begin:int,end:int>>").alias("spans"))
    return hot.unionByName(clean).withColumn("contaminated", F.col("n_hit") > 0)
