"""Best-fit packing under conflicts: a sequence holds no two documents of one source or of one cluster of duplicates."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import stored

#: Tokens of a sequence, pieces that are packed together, seed.
CAPACITY, SHARD, SEED = 2048, 2048, 42


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY) -> list[int]:
    """The bin of each piece, taken in the order given. Sources and clusters are small numbers; -1 conflicts with none.

    Bins stand in the order of what is left in them and carry a bitmap of their sources and one of their clusters. The
    first bin with room for a piece is the tightest; from there the search goes to the next while the bitmaps conflict,
    and opens a new bin if none is left. Full bins are taken out.
    """
    order: list[tuple[int, int]] = []
    has_source: list[int] = []
    has_cluster: list[int] = []
    out = []
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(order, (size, -1))
        while at < len(order) and (has_source[order[at][1]] & s or has_cluster[order[at][1]] & c):
            at += 1
        if at < len(order):
            left, bin_at = order.pop(at)
        else:
            left, bin_at = capacity, len(has_source)
            has_source.append(0)
            has_cluster.append(0)
        has_source[bin_at] |= s
        has_cluster[bin_at] |= c
        if left > size:
            insort(order, (left - size, bin_at))
        out.append(bin_at)
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", n_tokens: str = "n_tokens", source: str = "source", cluster: str = "cluster", capacity: int = CAPACITY, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """(bin_id, slot, doc_id, copy, start, n_tokens, bin_tokens): where each piece of each row of `docs` stands.

    A document longer than `capacity` is cut: pieces of `capacity` fill a sequence each, the rest is packed. Pieces are
    dealt by hash to shards of about `shard`, and each shard is packed by best fit, largest first; ties by doc_id
    as text and copy. `copy` numbers rows of equal doc_id, source, cluster and size from zero. `start` is the token at which a
    piece begins. A null source or cluster conflicts with nothing; a null or negative size is zero tokens, and such a
    document takes a slot of no tokens; a null doc_id is kept. A bin's documents differ in source and cluster. Other
    columns are ignored; an empty table gives an empty table. Only keys and sizes are shuffled, hot sources and
    repeated rows spread over all shards, and nothing is left out: shards bound a task, not the result.
    """
    size = F.greatest(F.coalesce(F.col(n_tokens).cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(cluster).cast("string").alias("cluster"), size.alias("size"))
    rows = rows.groupBy("doc_id", "source", "cluster", "size").agg(F.count("*").alias("copies"))
    rows = stored(rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).drop("copies"), "rows")
    shards = max(1, -(-rows.count() // shard))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "source", "cluster", "size", "copy", F.lit(seed)), F.lit(shards)))
    whole = rows.where(F.col("size") >= capacity).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"size div {capacity}") - 1)))
    # A sequence that one piece fills has an id of its own, below zero: bins of shards are numbered from zero.
    key = F.xxhash64("doc_id", "source", "cluster", "size", "copy", "i", F.lit(seed)).bitwiseOR(F.lit(-(1 << 63)))
    filled = whole.select(key.alias("bin_id"), F.lit(0).alias("slot"), "doc_id", "copy", (F.col("i") * capacity).alias("start"), F.lit(capacity).cast("long").alias("n_tokens"), F.lit(capacity).cast("long").alias("bin_tokens"))
    rest = rows.where((F.col("size") % capacity > 0) | (F.col("size") == 0)).withColumn("doc_id", F.col("doc_id").cast("string"))
    kind = dict(rows.dtypes)["doc_id"]

    def place(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(piece=part["size"] % capacity)
        part = part.sort_values(["piece", "doc_id", "copy", "source", "cluster", "size"], ascending=[False, True, True, True, True, True], kind="stable").reset_index(drop=True)
        codes = [pd.factorize(part[c])[0].tolist() for c in ("source", "cluster")]
        bins = pd.Series(best_fit(part["piece"].tolist(), *codes, capacity))
        return pd.DataFrame({
            "bin_id": part["shard"].astype("int64") * (1 << 24) + bins,
            "slot": part.groupby(bins).cumcount().astype("int32"),
            "doc_id": part["doc_id"],
            "copy": part["copy"],
            "start": part["size"] - part["piece"],
            "n_tokens": part["piece"],
            "bin_tokens": part["piece"].groupby(bins).transform("sum"),
        })

    packed = rest.groupBy("shard").applyInPandas(place, "bin_id long, slot int, doc_id string, copy long, start long, n_tokens long, bin_tokens long")
    return packed.withColumn("doc_id", F.col("doc_id").cast(kind)).unionByName(filled)
