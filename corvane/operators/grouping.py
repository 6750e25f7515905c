"""Grouping: content fingerprints, groups, tallies, gates, order statistics, elections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators.spans import CHUNK, along, spread


def fingerprint(items: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, fingerprint, n_files): SHA-1 over the sorted distinct digests of a group's files, a line each.

    Null where a group has a file without a digest. Digests are made distinct by a shuffle on key and digest first, so
    a group collects its distinct ones only.
    """
    distinct = items.groupBy(*keys, digest).agg(F.lit(1).alias("one"))
    lines = F.concat(F.array_join(F.array_sort(F.collect_list(digest)), "\n"), F.lit("\n"))
    return distinct.groupBy(*keys).agg(
        F.when(F.bool_and(F.col(digest).isNotNull()), F.sha1(lines)).alias("fingerprint"),
        F.count(digest).cast("long").alias("n_files"),
    )


def group_key(fingerprint: Column, name: Column) -> Column:
    """Members without a fingerprint stand alone under their own name."""
    return F.coalesce(fingerprint, F.concat(F.lit("set:"), name.cast("string")))


def dominant(items: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, value, n): the most frequent value of each group, ties to the smallest."""
    counts = items.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("order"), F.col(value), F.col("n"))).alias("top")).select(*keys, f"top.{value}", "top.n")


def year_span(year: Column, valid: Column) -> Column:
    """"a-b" over the valid years of a group, "a" if they are one, null if there is none."""
    low, high = F.min(F.when(valid, year)), F.max(F.when(valid, year))
    return F.when(low == high, low.cast("string")).otherwise(F.concat_ws("-", low.cast("string"), high.cast("string")))


def reasons(items: DataFrame, cases: list[tuple[str, Column]], rest: str) -> Column:
    """The first reason whose condition holds, a null condition being one that does not."""
    out = F.lit(rest)
    for name, when in reversed(cases):
        out = F.when(when, name).otherwise(out)
    return out


def gated(items: DataFrame, keys: list[str], energy: str) -> DataFrame:
    """(keys, n_blocks, mean_energy, lufs): mean energy over blocks at the absolute gate or above, then over those at
    a tenth of that mean or above. Groups without such blocks have nulls.

    Two passes of partial sums and a join on the group, not a window: a hot group is summed by all tasks.
    """
    gate = 10 ** ((X.ABSOLUTE_GATE - X.OFFSET) / 10)
    heard = items.where(F.col(energy) >= gate)
    first = heard.groupBy(*keys).agg(F.avg(energy).alias("mean"))
    limit = F.greatest(F.lit(gate), F.col("mean") * 10 ** (X.RELATIVE_GATE / 10))
    second = heard.join(first, keys).where(F.col(energy) >= limit).groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.avg(energy).alias("mean_energy"))
    out = items.select(*keys).distinct().join(second, keys, "left")
    return out.select(*keys, F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"), "mean_energy", X.energy_to_lufs(F.col("mean_energy")).alias("lufs"))


def order_statistics(items: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, a column for each rank): the values at zero-based ranks of each group's sorted values.

    `ranks` gives a rank from the group's count. Equal values are counted first, so what a group brings to one task are
    its distinct values; a group of more rows than a task should order is dealt by ranges of values, which pass on only
    their counts.
    """
    known = items.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count("*").alias("__c"))
    seen = along(spread(counts, keys, [value], sized=known), keys, [value], sums={"__upto": F.col("__c")})
    total = known.groupBy(*keys).agg(F.count("*").alias("__n"))
    seen = seen.join(total, keys) if CHUNK in seen.columns else seen.withColumn("__n", F.sum("__c").over(W.partitionBy(*keys)))
    at = lambda rank: F.min(F.when(F.col("__upto") > rank(F.col("__n")), F.col(value)))
    return seen.groupBy(*keys).agg(F.max("__n").alias("n"), *[at(rank).alias(name) for name, rank in ranks.items()])


LOWER_MIDDLE = lambda n: F.floor((n - 1) / 2)
UPPER_MIDDLE = lambda n: F.floor(n / 2)
P99_INDEX = lambda n: F.floor((n - 1) * 99 / 100)


def median(items: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, median): the middle value, or the mean of the two middle ones, to three digits."""
    found = order_statistics(items, keys, value, {"lo": LOWER_MIDDLE, "hi": UPPER_MIDDLE})
    return found.select(*keys, "n", X.rounded((F.col("lo") + F.col("hi")) / 2, 3).alias("median"))


def spread_around_upper_median(items: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, n, middle, mad): the upper median and 1.4826 times the upper median of distances from it."""
    middle = order_statistics(items, keys, value, {"middle": UPPER_MIDDLE})
    away = items.join(middle.drop("n"), keys).withColumn("__away", F.abs(F.col(value) - F.col("middle")))
    mad = order_statistics(away, keys, "__away", {"mad": UPPER_MIDDLE})
    return middle.join(mad.drop("n"), keys).select(*keys, "n", "middle", (F.col("mad") * 1.4826).alias("mad"))


def inlier_gain(items: DataFrame, keys: list[str], value: str, within: float) -> DataFrame:
    """(keys, gain, n_inliers, n_outliers, spread): the median of the values within `within` of the median of all."""
    first = median(items, keys, value).withColumnRenamed("median", "__m").drop("n")
    near = items.join(first, keys).withColumn("__in", F.abs(F.col(value) - F.col("__m")) <= within)
    counts = near.groupBy(*keys).agg(
        F.count_if("__in").alias("n_inliers"),
        F.count_if(~F.col("__in")).alias("n_outliers"),
        (F.max(F.when(F.col("__in"), F.col(value))) - F.min(F.when(F.col("__in"), F.col(value)))).alias("spread"),
    )
    return counts.join(median(near.where("__in"), keys, value).select(*keys, F.col("median").alias("gain")), keys, "left")


def top_with_remainder(items: DataFrame, keys: list[str], order: list[Column], columns: list[str], most: int) -> DataFrame:
    """The first `most` rows of each group in `order`, their rank, and how many more the group has.

    The limit is what the operator reports. Spark cuts groups to `most` rows before the shuffle.
    """
    counts = items.groupBy(*keys).agg(F.count("*").alias("__n"))
    ranked = items.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(counts, keys).select(*keys, "rank", *columns, F.greatest(F.col("__n") - most, F.lit(0)).cast("long").alias("more"))


def channel_mask(items: DataFrame, keys: list[str], channel: str) -> DataFrame:
    """(keys, mask): a bit for each channel, 0 to 62, that a group's rows have."""
    return items.groupBy(*keys).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({channel} as int))")).alias("mask"))


def elect(items: DataFrame, keys: list[str], candidate: str, voice: Column) -> DataFrame:
    """(keys, candidate, voices, n): of the candidates that most of whose rows are voices the one with most voices,
    ties to the smallest; groups without one are left out."""
    counts = items.groupBy(*keys, candidate).agg(F.count_if(voice).alias("voices"), F.count("*").alias("n")).where("voices * 2 > n")
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("voices")).alias("order"), F.col(candidate), F.col("voices"), F.col("n"))).alias("t")).select(*keys, f"t.{candidate}", "t.voices", "t.n")


def best_by(items: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The first row of each group in `order`, by a partial minimum: nothing is sorted."""
    marks = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    best = items.groupBy(*keys).agg(F.min(F.struct(*marks, *[F.col(c) for c in columns])).alias("__b"))
    return best.select(*keys, *[F.col("__b")[c].alias(c) for c in columns])
