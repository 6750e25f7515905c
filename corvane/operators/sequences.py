"""Ordered sequences: islands, runs, fills, neighbours, blocks, recurrences."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.series import lag_pairs
from corvane.operators.signals import one_pole
from corvane.operators.spans import CHUNK, along, spread


def islands(items: DataFrame, keys: list[str], at: str, gap: int, order: list[str]) -> DataFrame:
    """(keys, first, last, n): stretches whose neighbours are `gap` or less apart."""
    rows = spread(items, keys, [at, *order])
    rows = along(rows, keys, [at, *order], lags={"__before": F.col(at)})
    new = F.coalesce((F.col(at) - F.col("__before") > gap).cast("long"), F.lit(1))
    marked = along(rows.withColumn("__new", new), keys, [at, *order], sums={"__id": F.col("__new")})
    return marked.groupBy(*keys, "__id").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).drop("__id")


def runs(items: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """(keys, value, begin, n): runs of equal values; `begin` is the zero-based place of the first row."""
    rows = along(spread(items, keys, order), keys, order, lags={"__before": F.col(value)}, sums={"__at": F.lit(1)})
    new = (~F.col(value).eqNullSafe(F.col("__before")) | (F.col("__at") == 1)).cast("long")
    marked = along(rows.withColumn("__new", new), keys, order, sums={"__id": F.col("__new")})
    return marked.groupBy(*keys, "__id", value).agg((F.min("__at") - 1).cast("long").alias("begin"), F.count("*").alias("n")).drop("__id")


def longest_run(items: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """The longest run of each group, the first of equals."""
    best = runs(items, keys, order, value).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("o"), F.col("begin"), F.col(value), F.col("n"))).alias("b"))
    return best.select(*keys, f"b.{value}", "b.begin", "b.n")


def forward_fill(items: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`items` with the last value that was not null up to each row."""
    return along(spread(items, keys, order), keys, order, lasts={name: value}).drop(CHUNK)


def first_place_last_name(items: DataFrame, keys: list[str], order: Column, name: str) -> DataFrame:
    """(keys, place, name): a key keeps its first place and takes its last name."""
    found = items.groupBy(*keys).agg(F.min(order).alias("place"), F.max(F.struct(order.alias("o"), F.col(name).alias("v"))).alias("m"))
    return found.select(*keys, "place", F.col("m.v").alias(name))


def profiles(items: DataFrame, kind: str, depth: str, full: float) -> DataFrame:
    """(kind, depth, profile): depths below `full` of each kind numbered from one, the lightest first; `full` is 0.

    Depths are made distinct first: the window ranks the few settings, not the rows that use them.
    """
    distinct = items.select(kind, depth).distinct()
    rank = F.dense_rank().over(W.partitionBy(kind, F.col(depth) < full).orderBy(F.desc(depth)))
    return distinct.withColumn("profile", F.when(F.col(depth) < full, rank).otherwise(0))


def novelty(items: DataFrame, keys: list[str], order: list[str], value: str, at: str) -> DataFrame:
    """(keys, before, value, at): the first time that a value follows another; `before` is null at the start."""
    pairs = along(spread(items, keys, order), keys, order, lags={"before": F.col(value)})
    return pairs.groupBy(*keys, "before", value).agg(F.min(at).alias(at))


def numbered(items: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`items` with the place of each row in its key, from one."""
    return along(spread(items, keys, order), keys, order, sums={name: F.lit(1).cast("long")}).drop(CHUNK)


def blocks(items: DataFrame, keys: list[str], order: list[str], n: int, value: str) -> DataFrame:
    """(keys, block, rms): whole blocks of `n` rows; a last one that is not full is left out."""
    placed = numbered(items, keys, order, "__at").withColumn("block", F.floor((F.col("__at") - 1) / n).cast("long"))
    found = placed.groupBy(*keys, "block").agg(F.count("*").alias("c"), F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"))
    return found.where(F.col("c") == n).drop("c")


def sliding(blocks: DataFrame, keys: list[str], block: str, value: str, width: int) -> DataFrame:
    """(keys, block, mean): means over `width` steps that end at each block; the first ones, not yet full, left out.

    A block is part of the next `width` ones, numbers being whole and without gaps: partial sums, so a long series is no
    single task.
    """
    parts = blocks.select(*keys, F.explode(F.sequence(F.col(block), F.col(block) + (width - 1))).alias(block), value)
    return parts.groupBy(*keys, block).agg(F.avg(value).alias("mean"), F.count("*").alias("c")).where(F.col("c") == width).drop("c")


def lag_difference(items: DataFrame, keys: list[str], at: str, value: str, lags: int) -> DataFrame:
    """(keys, lag, n, diff): how much a series differs from itself `lag` places on, 1 to `lags`; a key is dealt in blocks."""
    pairs = lag_pairs(items, keys, at, value, lags)
    return pairs.groupBy(*keys, "lag").agg(F.count("*").alias("n"), F.sum(F.abs(F.col("before") - F.col("value"))).alias("diff"))


def next_distinct(items: DataFrame, keys: list[str], at: str, name: str) -> DataFrame:
    """(keys, at, name): each different place of a key and the next one; null for the last."""
    places = items.select(*keys, at).distinct()
    return along(spread(places, keys, [at]), keys, [at], leads={name: F.col(at)}).drop(CHUNK)


def decayed(items: DataFrame, keys: list[str], order: list[str], value: str, r: float, part: int = 1 << 16) -> DataFrame:
    """(keys, i, y): y[i] = x[i] - x[i-1] + r y[i-1] from y[0] = 0, by parts of `part` rows of a key.

    A part is filtered by itself in its task; what goes on to the next part is its last value, of which r ** part is left
    at its end. That is nothing in double precision, so no part waits for more than the one before it.
    """
    if r**part > 1e-20:
        raise ValueError(f"of a part's state {r**part} is left at the end of the next: take longer parts")
    placed = along(spread(items, keys, order), keys, order, lags={"__was": F.col(value)}, sums={"__at": F.lit(1).cast("long")})
    rows = placed.select(*keys, (F.col("__at") - 1).alias("i"), F.coalesce(F.col(value) - F.col("__was"), F.lit(0.0)).alias("__d"))
    rows = rows.withColumn("__part", F.expr(f"i div {part}"))
    parts = rows.groupBy(*keys, "__part").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "__d"))), lambda e: e["__d"]).alias("__d"))

    def run(batches):
        for batch in batches:
            yield batch.drop(columns="__d").assign(y=[one_pole(np.asarray(d, float), r) for d in batch["__d"]])

    kinds = dict(parts.dtypes)
    alone = parts.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "__part")) + ", y array<double>")
    carried = F.lag(F.element_at("y", -1)).over(W.partitionBy(*keys).orderBy("__part"))
    out = alone.withColumn("__carry", F.coalesce(carried, F.lit(0.0))).select(*keys, "__part", "__carry", F.posexplode("y").alias("__k", "y"))
    return out.select(*keys, (F.col("__part") * part + F.col("__k")).alias("i"), (F.col("y") + F.col("__carry") * F.pow(F.lit(r), F.col("__k") + 1)).alias("y"))


def recurrence(items: DataFrame, keys: list[str], at: str, state: str) -> DataFrame:
    """(keys, distance, n): distances to the same state's last occurrence, those that are found twice at least."""
    rows = along(spread(items, [*keys, state], [at]), [*keys, state], [at], lags={"__before": F.col(at)})
    far = rows.withColumn("distance", (F.col(at) - F.col("__before")).cast("long")).where("distance > 1")
    return far.groupBy(*keys, "distance").agg(F.count("*").alias("n")).where("n >= 2")


def column_profile(items: DataFrame, keys: list[str], order: list[str], value: str, fast: float = 0.5) -> DataFrame:
    """(keys, n, changes, rising, is_fast): how a byte moves: changes, whether it only steps up by 1 to 64 modulo 256,
    and whether it changes in at least the share `fast` of its steps."""
    rows = along(spread(items, keys, order), keys, order, lags={"__before": F.col(value)})
    step = rows.withColumn("__s", F.pmod(F.col(value) - F.col("__before"), F.lit(256)))
    moved = F.col("__s") != 0
    return step.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(moved).alias("changes"),
        F.coalesce(F.bool_and(F.when(moved, F.col("__s").between(1, 64))), F.lit(False)).alias("rising"),
        (F.count_if(moved) >= fast * F.greatest(F.count("*") - 1, F.lit(1))).alias("is_fast"),
    )


def clean_suffix(items: DataFrame, keys: list[str], at: str, good: Column) -> DataFrame:
    """(keys, start, n): where the last stretch of good rows begins and its size, by sums alone: after the last bad."""
    last_bad = items.groupBy(*keys).agg(F.max(F.when(~good, F.col(at))).alias("__bad"))
    tail = items.join(last_bad, keys).where(F.col("__bad").isNull() | (F.col(at) > F.col("__bad")))
    return tail.groupBy(*keys).agg(F.min(at).alias("start"), F.count("*").alias("n"))


def cut_by_next(items: DataFrame, keys: list[str], begin: str, end: str, order: list[str]) -> DataFrame:
    """`items` with `next_begin` of the same voice, and whether it cuts this row off before its end."""
    rows = along(spread(items, keys, [begin, *order]), keys, [begin, *order], leads={"next_begin": F.col(begin)}).drop(CHUNK)
    return rows.withColumn("is_cut", F.coalesce(F.col("next_begin") < F.col(end), F.lit(False)))


def first_after(requests: DataFrame, replies: DataFrame, keys: list[str], at: str) -> DataFrame:
    """(keys, asked, answered): the first request of each key and the first reply at or after it, else null."""
    asked = requests.groupBy(*keys).agg(F.min(at).alias("asked"))
    answers = replies.select(*keys, F.col(at).alias("__r")).join(asked, keys).where(F.col("__r") >= F.col("asked"))
    return asked.join(answers.groupBy(*keys).agg(F.min("__r").alias("answered")), keys, "left")
