"""SimHash near-dedup over an inverted index of positional bytes with count filtering."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import components, few, small_batches, stored, text_udf

#: Words of a shingle, seed of its hash, and bits by which linked fingerprints may differ.
SHINGLE, SEED, MAX_BITS = 3, 42, 2
#: Fingerprints of a posting list beyond which it is split.
LONG_LIST = 4096
#: Byte positions that are indexed together: the quadruples whose numbers cancel out. Two positions are together in three
#: of the fourteen, so fingerprints that share 8 - d positional bytes, d being 0 to 3, meet in 14, 7, 3 or 1 lists at least.
QUADS = [at for at in combinations(range(8), 4) if at[0] ^ at[1] ^ at[2] ^ at[3] == 0]
MOST_BITS = 3
#: The bits of each byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
#: Where the counts of each position's byte values begin, and hashes that are counted at once.
_PLACES, AT_ONCE = np.arange(8) * 256, 65_536


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint as a signed long: a bit is set if it is in over half the XXH64 of the text's shingles.

    A-Z are lower-cased; words are runs of bytes other than blank and 9 to 13, which is what bytes.split() yields.
    A text with fewer words than a shingle has is one shingle; one without words, or null, has fingerprint zero.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    joined, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = ends - lengths, ends[min(shingle, len(words)) - 1 :]
    one = xxhash.xxh64_intdigest
    hashed = np.fromiter((one(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(ends))
    return majority(hashed)


def majority(hashed: np.ndarray) -> int:
    """The fingerprint of 64-bit hashes: the bits that over half of them have, as a signed long."""
    columns, times = hashed.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), np.zeros(8 * 256, np.int64)
    for at in range(0, len(columns), AT_ONCE):
        times += np.bincount((columns[at : at + AT_ONCE] + _PLACES).ravel(), minlength=len(times))
    ones = (times.reshape(8, 256).astype(np.float64) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashed), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): a row for each row of `docs`. Map-only."""
    fp = text_udf(lambda texts: [simhash(x, shingle) for x in texts], "long", pa.int64())
    return docs.select(F.col(doc_id).alias("doc_id"), fp(F.col(text)).alias("fp"))


def tally(here: int, rest: np.ndarray) -> np.ndarray:
    """How many positional bytes the fingerprint `here` shares with each of `rest`, all unsigned."""
    return ((rest ^ np.uint64(here)).view(np.uint8).reshape(-1, 8) == 0).sum(1)


def spanning(found: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what linked fingerprints of the posting list `found` connect, fewer than it has fingerprints.

    Walks from fingerprint to fingerprint. Of those not yet reached, the shared positional bytes are tallied, pairs
    below the guaranteed minimum of 8 - max_bits are dropped, and the others are verified by their differing bits.
    """
    rest, out = found, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            here = queue.pop()
            kept = np.flatnonzero(tally(here, rest) >= 8 - max_bits)
            near = kept[np.bitwise_count(rest[kept] ^ here) <= max_bits]
            if len(near):
                out += [(int(here), int(x)) for x in rest[near]]
                queue += list(rest[near])
                rest = np.delete(rest, near)
    return out


def _masks(quads: list[tuple[int, ...]]) -> list[int]:
    unsigned = [sum(0xFF << 8 * i for i in at) for at in quads]
    return [m - (1 << 64) if m >> 63 else m for m in unsigned]


def links(fps: DataFrame, max_bits: int = MAX_BITS, long_list: int = LONG_LIST) -> DataFrame:
    """(a, b): links between the distinct fingerprints of `fps` (fp), enough to connect whatever is linked.

    Fingerprints that differ in `max_bits` bits (3 at most) share 8 - max_bits positional bytes at least, so they meet in
    a posting list of four positional bytes. In a list, the shared bytes of a pair are tallied over all positions; pairs
    below the guaranteed minimum are dropped and the others verified. Lists are counted first: one of over `long_list`
    fingerprints is split by the values of any further positions that its linked pairs are bound to share (two of the
    other four, for two bits), so a list that goes through a task has `long_list`, or 256 ** max_bits, entries at most.
    """
    if not 0 <= max_bits <= MOST_BITS:
        raise ValueError(f"the index guarantees matches up to {MOST_BITS} differing bits, not {max_bits}")
    masks = _masks(QUADS)
    further = [_masks([tuple(sorted({*at, *more})) for more in combinations([i for i in range(8) if i not in at], 4 - max_bits)]) for at in QUADS]
    spark = fps.sparkSession
    # So many postings come of each fingerprint that they are dealt out before, however few bytes they have; by a hash,
    # as Spark leaves out a deal by the column that they are already dealt by.
    fps = fps.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    entry = [F.struct(F.lit(i).alias("at"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, m in enumerate(masks)]
    postings = fps.select("fp", F.explode(F.array(*entry)).alias("p")).select("fp", "p.at", "p.value")
    counts = stored(postings.groupBy("at", "value").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    long = counts.where(F.col("n") > long_list)
    finer = spark.createDataFrame([(i, m) for i, row in enumerate(further) for m in row], "at int, finer long")
    split = few(long).join(F.broadcast(finer), "at").select("at", "value", "finer")
    split = postings.join(split, ["at", "value"]).select("fp", F.col("finer").alias("at"), F.col("fp").bitwiseAND(F.col("finer")).alias("value"))
    short = postings.join(few(counts.where(F.col("n") <= long_list)).select("at", "value"), ["at", "value"]).select("fp", F.col("at").cast("long").alias("at"), "value")
    lists = short.unionByName(split).groupBy("at", "value").agg(F.collect_set("fp").alias("fps")).where(F.size("fps") > 1)

    def verify(batches):
        for batch in batches:
            pairs = [x for found in batch["fps"] for x in spanning(np.array(found, "<i8").view("<u8"), max_bits)]
            yield pd.DataFrame(np.array(pairs, "<u8").reshape(-1, 2).view("<i8"), columns=["a", "b"])

    return lists.select("fps").mapInPandas(verify, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): a row for each row of `docs`; component_id is the smallest doc_id that links reach.

    Fingerprints link at `max_bits` or fewer differing bits; documents of one fingerprint are together. Texts without
    words, null ones included, have fingerprint zero and are linked like any other. A null doc_id is kept and never
    the smallest unless its whole group has none. Repeated rows stay; an empty table gives an empty table; other columns
    are ignored. Texts never leave the first, map-only pass: from there on only distinct fingerprints are indexed, so
    thousands of copies are one, and the links of a group grow with its size, not with its square.
    """
    with small_batches(docs.sparkSession):
        found = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    reps = stored(found.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = stored(components(links(reps.select("fp"), max_bits)).withColumnRenamed("node", "fp"), "roots")
    # Few fingerprints have a link: groups of those are joined on, and all others stand for themselves.
    linked = reps.join(few(roots), "fp")
    least = linked.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = linked.join(few(stored(least, "least")), "component").select("fp", "component_id")
    every = reps.join(few(stored(linked, "linked")), "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return found.join(every, "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """`docs` with the document of the smallest id of each group; rows that repeat an id are copies, and one stays."""
    groups = near_duplicates(docs, doc_id, text, shingle, max_bits)
    kept = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    chosen = docs.join(kept, F.col(doc_id).eqNullSafe(F.col("__kept")), "left_semi")
    return chosen.dropDuplicates([doc_id])
