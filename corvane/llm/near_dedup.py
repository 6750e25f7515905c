"""Near-dedup at a Jaccard similarity of 0.8 on five-word shingles: SimHash links first, MinHash bands for pairs that
no guaranteed match of positional bytes reaches; whole shingle sets decide.

Two texts that are 0.8 alike differ in about ten of 64 fingerprint bits, so they need not share one positional byte, and
the index of SimHash alone would miss most of them. MinHash bands propose those.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm import simhash
from corvane.llm.common import TEXTS, components, discard, few, small_batches, stored, text_udf

#: Words of a shingle, least similarity of linked texts, seed.
SHINGLE, THRESHOLD, SEED = 5, 0.8, 42
#: Bands and the minima in each: a pair at the threshold meets in a bucket with 1 - (1 - 0.8 ** 5) ** 24 = 0.99993.
BANDS, ROWS = 24, 5
#: Shingles from which minima are taken of parts of the set (one pass) instead of under as many functions.
MANY = 128
#: Standard deviations below the threshold at which a pair's share of equal minima rules it out: a pair at the threshold
#: falls short of it once in 3,000,000 times, less often than it misses all buckets.
SPREAD = 5
#: Members of a bucket that are compared with each other at once, and rows of a task that compares buckets.
BLOCK, TASK_ROWS = 1024, 8192
#: Likely pairs for each member of a block up to which they are listed; blocks of more are compared whole, set by set.
LISTED = 4
#: Shingles that are counted at once in a block that is compared whole.
COLUMNS = 4096

_rng = np.random.default_rng(SEED)
_N = BANDS * ROWS
_FACTORS, _TERMS = (_rng.integers(0, 1 << 64, (_N, 1), np.uint64, endpoint=False) for _ in range(2))
_FACTORS |= np.uint64(1)
#: Where an empty part borrows its minimum, by attempt.
_BORROW = _rng.integers(0, _N, (512, _N))


def _finished(x: np.ndarray) -> np.ndarray:
    """Bits of `x`, spread over all 64."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _mixed(columns, start: np.ndarray) -> np.ndarray:
    out = start
    for column in columns:
        out = _finished((out ^ column) * np.uint64(0xBF58476D1CE4E5B9))
    return out


#: Which bytes are part of a word.
_SOLID = ~np.isin(np.arange(256), [32, *range(9, 14)])


class _Powers:
    """Powers of an odd number and of its inverse, to as many as a text has bytes."""

    base, inverse = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 1 << 64)
    up = down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = 1 << n.bit_length()
            cls.up, cls.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (cls.base, cls.inverse))
        return cls.up[:n], cls.down[:n]


def word_hashes(text: str | None) -> np.ndarray:
    """A hash of each word of the text: of its bytes as a polynomial, A-Z lower-cased; words are runs of bytes other than
    blank and 9 to 13."""
    raw = np.frombuffer(text.encode().lower() if text else b"", np.uint8)
    solid = np.zeros(len(raw) + 2, bool)
    np.take(_SOLID, raw, out=solid[1:-1])
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _Powers.of(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(raw.astype(np.uint64) * up)])
    return _finished((sums[end] - sums[start]) * down[start])


def shingles(text: str | None, shingle: int = SHINGLE) -> tuple[int, np.ndarray]:
    """A hash of the text's sequence of words, and the sorted distinct hashes of its shingles.

    A text with fewer words than a shingle has is one shingle; one without words, or null, has none and the hash 0.
    """
    words = word_hashes(text)
    if not len(words):
        return 0, words
    n = min(shingle, len(words))
    last = len(words) - n + 1
    joined = np.full(last, n, np.uint64)
    for j in range(n):
        joined = joined * np.uint64(0xD1342543DE82EF95) + words[j : last + j]
    found = np.sort(_finished(joined))
    return xxhash.xxh64_intdigest(words.tobytes(), SEED), found[np.concatenate([[True], found[1:] != found[:-1]])]


def _minima_few(found: np.ndarray) -> np.ndarray:
    """The minimum of the shingles under each of many hash functions."""
    return (found * _FACTORS + _TERMS).min(1)


def _minima_many(found: np.ndarray) -> np.ndarray:
    """The minimum of each of many parts of the shingles, which are sorted; empty parts borrow one, by a fixed order."""
    part = (found % np.uint64(_N)).astype(np.int64)
    least, full = np.zeros(_N, np.uint64), np.zeros(_N, bool)
    least[part[::-1]] = found[::-1]
    full[part] = True
    empty, out = np.flatnonzero(~full), least
    for turn in _BORROW:
        if not len(empty):
            break
        lender = turn[empty]
        able = full[lender]
        out[empty[able]] = least[lender[able]] + empty[able].astype(np.uint64)
        empty = empty[~able]
    return out


def sketches(sets: list[np.ndarray]) -> tuple[list[np.ndarray], list[bytes | None], list[bytes | None]]:
    """Bucket ids of each set of shingles, and the low bytes of its minima of either kind; nothing for no shingles.

    Sets of under `MANY` shingles have minima of the first kind, others of the second; those of up to MANY / THRESHOLD
    have both, so whatever is alike enough has one kind in common.
    """
    ids, low = [np.zeros(0, np.int64)] * len(sets), ([None] * len(sets), [None] * len(sets))
    for kind, minima in enumerate((_minima_few, _minima_many)):
        able = [i for i, x in enumerate(sets) if (len(x) >= MANY if kind else 0 < len(x) < MANY / THRESHOLD)]
        if not able:
            continue
        least = np.array([minima(sets[i]) for i in able])
        banded = np.moveaxis(least.reshape(-1, BANDS, ROWS), 2, 0)
        buckets = _mixed(banded, np.arange(BANDS, dtype=np.uint64) + np.uint64(kind * BANDS)).view(np.int64)
        for i, found, x in zip(able, buckets, (least >> np.uint64(17)).astype(np.uint8)):
            ids[i] = np.concatenate([ids[i], found]) if len(ids[i]) else found
            low[kind][i] = x.tobytes()
    return ids, *low


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    """`docs` without `text`, with hashes of the text (raw) and of its words (key), the number of its shingles (n), its
    fingerprint (fp), buckets and sketches."""

    def keys(texts: list) -> pa.Array:
        made = [shingles(x) for x in texts]
        ids, of_few, of_many = sketches([found for _, found in made])
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        columns = [
            pa.array(np.array([k for k, _ in made], np.uint64).view(np.int64)),
            pa.array(np.array([len(found) for _, found in made], np.int32)),
            pa.array([simhash.majority(found) if len(found) else 0 for _, found in made], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *ids]))),
            pa.array(of_few, pa.binary()),
            pa.array(of_many, pa.binary()),
        ]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    kind = pa.struct({"key": pa.int64(), "n": pa.int32(), "fp": pa.int64(), "buckets": pa.list_(pa.int64()), "few": pa.binary(), "many": pa.binary()})
    judged = text_udf(keys, "key long, n int, fp long, buckets array<long>, few binary, many binary", kind)(F.col(text))
    kept = [c for c in docs.columns if c != text]
    out = docs.select(*kept, F.xxhash64(text).alias("__raw"), judged.alias("__k"))
    return out.select(*kept, "__raw", "__k.*")


def _least_equal(threshold: float) -> float:
    return _N * threshold - SPREAD * math.sqrt(_N * threshold * (1 - threshold))


def _equal(one: pd.Series, two: pd.Series) -> np.ndarray:
    """How many minima pairs of sketches have in common, -1 where either is missing."""
    out, both = np.full(len(one), -1), (one.notna() & two.notna()).to_numpy()
    if both.any():
        a, b = (np.frombuffer(b"".join(x[both]), np.uint8).reshape(-1, _N) for x in (one, two))
        out[both] = (a == b).sum(1)
    return out


def _likely(pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b): the distinct `pairs` (x, y: structs of key, n, few, many) whose sizes and sketches leave them a chance."""

    @F.pandas_udf("int")
    def equal(few_x: pd.Series, few_y: pd.Series, many_x: pd.Series, many_y: pd.Series) -> pd.Series:
        return pd.Series(np.maximum(_equal(few_x, few_y), _equal(many_x, many_y)), dtype="int32")

    sized = pairs.where(F.col("x.key") != F.col("y.key")).where(F.least("x.n", "y.n") / F.greatest("x.n", "y.n") >= threshold)
    alike = sized.where(equal("x.few", "y.few", "x.many", "y.many") >= _least_equal(threshold))
    return alike.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def _sets(docs: DataFrame, found: DataFrame, wanted: DataFrame, text: str) -> DataFrame:
    """(key, set): the shingles of each key of `wanted` (key), from one of the texts that have it."""
    raws = stored(found.join(few(wanted), "key", "left_semi").groupBy("key").agg(F.min("__raw").alias("__raw")).select("__raw"), "raws")
    texts = docs.select(F.xxhash64(text).alias("__raw"), F.col(text).alias("text")).join(few(raws), "__raw", "left_semi")

    def sets(batches):
        seen = set()
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part, new = batch.slice(at, TEXTS), []
                for raw, x in zip(part["__raw"].to_pylist(), part["text"].to_pylist()):
                    if raw not in seen:
                        seen.add(raw)
                        new.append(shingles(x))
                keys = np.array([k for k, _ in new], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.view(np.int64) for _, s in new], pa.list_(pa.int64()))], ["key", "set"])

    with small_batches(docs.sparkSession):
        out = stored(texts.mapInArrow(sets, "key long, set array<long>").dropDuplicates(["key"]), "sets")
    discard(raws)
    return out


def _verified(docs: DataFrame, found: DataFrame, pairs: DataFrame, text: str, threshold: float) -> DataFrame:
    """(a, b): those `pairs` whose whole shingle sets are similar enough, as a stored table."""
    pairs = stored(pairs, "pairs")
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "wanted")
    sets = _sets(docs, found, wanted, text)
    both = pairs.join(sets.select(F.col("key").alias("a"), F.col("set").alias("one")), "a").join(sets.select(F.col("key").alias("b"), F.col("set").alias("two")), "b")
    common = F.size(F.array_intersect("one", "two"))
    out = stored(both.where(common / (F.size("one") + F.size("two") - common) >= threshold).select("a", "b"), "linked")
    discard(pairs, wanted, sets)
    return out


def _by_simhash(keys: DataFrame, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """(x, y): keys of equal fingerprints, each with the least of them, and those of linked fingerprints."""
    reps = stored(keys.groupBy("fp").agg(F.min_by(F.struct("key", "n", "few", "many"), "key").alias("rep"), F.count("*").alias("of")), "fingerprints")
    one = F.struct("key", "n", "few", "many").alias("x")
    equal = keys.join(few(reps.where("of > 1")), "fp").select(one, F.col("rep").alias("y"))
    linked = stored(simhash.links(reps.select("fp"), max_bits).distinct(), "links")
    near = few(linked).join(reps.select(F.col("fp").alias("a"), F.col("rep").alias("x")), "a").join(reps.select(F.col("fp").alias("b"), F.col("rep").alias("y")), "b").select("x", "y")
    return equal.unionByName(near)


def _live(postings: DataFrame) -> DataFrame:
    """(bucket, lead, size): the buckets of `postings` (bucket, key, root) that hold several roots; lead is a member."""
    lead = F.min_by("key", F.struct(F.xxhash64("key"), "key")).alias("lead")
    heads = postings.groupBy("bucket").agg(lead, F.min("root").alias("__least"), F.max("root").alias("__most"), F.count("*").alias("size"))
    return stored(heads.where("__least != __most").select("bucket", "lead", "size"), "heads")


def _members(keys: DataFrame) -> DataFrame:
    """(bucket, key, n, few, many, lead): the members of buckets that hold several keys."""
    postings = keys.select("key", F.explode("buckets").alias("bucket"))
    heads = _live(postings.withColumn("root", F.col("key")))
    return postings.join(few(heads.drop("size")), "bucket").join(keys.select("key", "n", "few", "many"), "key")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """`members` of buckets that hold keys that no link connects yet, with the root of each and the bucket's size."""
    rooted = members.drop("lead").join(few(roots), "key", "left").withColumn("root", F.coalesce("component", "key")).drop("component")
    return rooted.join(few(_live(rooted.select("bucket", "key", "root"))).drop("lead"), "bucket")


def _by_leads(members: DataFrame, keys: DataFrame) -> DataFrame:
    """(x, y): each member of a bucket with the bucket's lead."""
    leads = stored(members.select("lead").distinct(), "leads")
    leads = few(leads).join(keys.select(F.col("key").alias("lead"), F.struct("key", "n", "few", "many").alias("y")), "lead")
    return members.select("lead", F.struct("key", "n", "few", "many").alias("x")).join(few(stored(leads, "lead_rows")), "lead").select("x", "y")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """`members` dealt to blocks of about `block` rows of a bucket: a row for each pair of blocks, bi and bj, that a
    member is part of."""
    parts = F.ceil(F.col("size") / block).cast("int")
    placed = members.withColumn("part", F.pmod(F.xxhash64("key", F.lit("part")), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    return placed.select("bucket", F.least("part", "other").alias("bi"), F.greatest("part", "other").alias("bj"), "part", "key", "n", "few", "many", "root")


def _by_blocks(dealt: DataFrame, threshold: float, listed: int = LISTED) -> DataFrame:
    """(bucket, bi, bj, whole, a, b): the likely pairs of each pair of blocks that no link connects yet. Where they are
    over `listed` for each member there is one row without a pair, and whole is true: that block is compared whole."""
    least = _least_equal(threshold)
    tasks = max(1, -(-dealt.count() // TASK_ROWS))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["bucket", "bi", "bj", "key"]).reset_index(drop=True)
        bucket, key, n, root, part, bi, bj = (rows[c].to_numpy() for c in ("bucket", "key", "n", "root", "part", "bi", "bj"))
        of = [np.frombuffer(b"".join(x if x is not None else bytes(_N) for x in rows[c]), np.uint8).reshape(-1, _N) for c in ("few", "many")]
        has = [rows[c].notna().to_numpy() for c in ("few", "many")]
        ends = np.flatnonzero(np.diff(rows.groupby(["bucket", "bi", "bj"], sort=False).ngroup().to_numpy(), append=-1)) + 1
        out, start = [], 0
        for end in ends:
            # All pairs of a few rows at once, else a row at a time.
            step, found, n_found = max(1, BLOCK // (end - start)), [], 0
            for at in range(start, end, step):
                i, j = np.meshgrid(np.arange(at, min(at + step, end)), np.arange(at + 1, end), indexing="ij")
                able = (i < j) & (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]))
                able &= (bi[start] == bj[start]) | (part[i] != part[j])
                i, j = i[able], j[able]
                if len(i):
                    equal = np.maximum(*[np.where(h[i] & h[j], (x[i] == x[j]).sum(1), -1) for x, h in zip(of, has)])
                    found.append(np.column_stack([key[i[equal >= least]], key[j[equal >= least]]]))
                    n_found += len(found[-1])
                    if n_found > listed * (end - start):
                        break
            name = (bucket[start], bi[start], bj[start])
            out += [(*name, True, 0, 0)] if n_found > listed * (end - start) else [(*name, False, a, b) for x in found for a, b in x.tolist()]
            start = end
        out = pd.DataFrame(out, columns=["bucket", "bi", "bj", "whole", "a", "b"])
        return out.astype({"bucket": "int64", "bi": "int32", "bj": "int32", "whole": bool, "a": "int64", "b": "int64"})

    dealt = dealt.withColumn("task", F.pmod(F.xxhash64("bucket", "bi", "bj"), F.lit(tasks)))
    return stored(dealt.groupBy("task").applyInPandas(compare, "bucket long, bi int, bj int, whole boolean, a long, b long"), "likely")


def similar(sets: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """The matrix of which of `sets`, sorted and distinct, are similar enough: common members are counted by products."""
    size = np.array([len(x) for x in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), size.astype(int))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # What only one set has is in no intersection.
    place = np.cumsum(times > 1) - 1
    row, column = row[times[column] > 1], place[column[times[column] > 1]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        low, high = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((len(sets), COLUMNS), np.float32)
        has[row[low:high], column[low:high] - at] = 1
        common += has @ has.T
    out = common / (size[:, None] + size - common) >= threshold
    np.fill_diagonal(out, True)
    return out


def _whole(dealt: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that connect what similar members of each pair of blocks connect, fewer than it has members."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows["key"].to_numpy()
        linked = similar([np.asarray(x, np.int64) for x in rows["set"]], threshold)
        rest, out = np.arange(len(key)), []
        while len(rest):
            queue, rest = [rest[0]], rest[1:]
            while queue and len(rest):
                here = queue.pop()
                near = linked[here, rest]
                out += [(key[here], k) for k in key[rest[near]]]
                queue += list(rest[near])
                rest = rest[~near]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return dealt.select("bucket", "bi", "bj", "key").join(sets, "key").groupBy("bucket", "bi", "bj").applyInPandas(compare, "a long, b long")


def links(docs: DataFrame, found: DataFrame, text: str, threshold: float = THRESHOLD, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """(a, b): links between keys of `found`, enough to connect whatever meets in a bucket and is similar enough.

    First come keys of linked fingerprints, and the members of each bucket with one of them, its lead; links of those
    connect a group of copies. Then all pairs of a bucket that are still apart are compared by their sketches: a text
    that is unlike the lead may be like any other, so nothing that met stays uncompared. Likely pairs are verified one by
    one; blocks of too many of them, as of texts that are nearly alike enough, are compared whole in their task.
    """
    keys = stored(found.select("key", "n", "fp", "buckets", "few", "many").dropDuplicates(["key"]).where("n > 0"), "keys")
    members = stored(_members(keys), "members")
    first = _verified(docs, found, _likely(_by_simhash(keys).unionByName(_by_leads(members, keys)), threshold), text, threshold)
    roots = stored(components(first).withColumnRenamed("node", "key"), "roots")
    dealt = stored(_blocks(_apart(members, roots), block), "blocks")
    discard(members)
    likely = _by_blocks(dealt, threshold, listed)
    out = first.unionByName(_verified(docs, found, likely.where("not whole").select("a", "b").distinct(), text, threshold))
    dense = stored(likely.where("whole").select("bucket", "bi", "bj"), "dense")
    if not dense.isEmpty():
        dealt = dealt.join(few(dense), ["bucket", "bi", "bj"])
        sets = _sets(docs, found, stored(dealt.select("key").distinct(), "wanted"), text)
        out = out.unionByName(stored(_whole(dealt, sets, threshold), "whole"))
    return out


def grouped(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without `text`, with `root`: the same number for all rows that links of similar texts connect.

    Texts of equal words are one, and count once, however many there are; those without words, null ones included, have
    root 0. A word sequence stands by a 64-bit hash. Every row stays, repeated ones too; an empty table gives an empty
    table. Columns of `docs` keep their names and values, but root, which is replaced.
    """
    kept = [c for c in docs.columns if c not in (text, "root")]
    packed = docs.select(F.struct(*[F.col(c) for c in kept]).alias("row") if kept else F.lit(None).alias("row"), F.col(text).alias("text"))
    with small_batches(docs.sparkSession):
        found = stored(_keyed(packed, "text"), "keys")
    roots = components(links(packed, found, "text", threshold)).withColumnRenamed("node", "key")
    # Few keys have a link, and many rows may have one key: the rows stay where they are while the roots are few.
    out = found.select("row", "key").join(few(stored(roots, "roots")), "key", "left")
    return out.select(*[F.col("row")[c].alias(c) for c in kept], F.coalesce("component", "key").alias("root"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with the document of the smallest id of each group; rows that repeat an id are copies, and one stays. A null
    id goes before no other: a group whose ids are all null keeps one row."""
    groups = stored(grouped(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")), "text", threshold), "groups")
    kept = groups.groupBy("root").agg(F.min("__id").alias("__kept")).select("__kept").distinct()
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col("__kept")), "left_semi").dropDuplicates([doc_id])
