"""Reconciliation: fills, donors, extras, intervals, coverage of calls, read-back, upserts. Joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared(groups: DataFrame, key: str, name: str, most: int = 6) -> DataFrame:
    """(name, n_others, others): how many other names have the same key, and the first `most` of them.

    A group's first names are found by partial aggregates, so no pairs of a large group are made. A null key is shared
    with none.
    """
    known = groups.where(F.col(key).isNotNull()).select(key, name).distinct()
    counted = known.groupBy(key).agg((F.count("*") - 1).alias("n_others"))
    first = smallest(known, [key], name, most + 1)
    others = F.slice(F.filter("first", lambda x: x != F.col(name)), 1, most)
    out = groups.select(key, name).distinct().join(counted, key, "left").join(first, key, "left")
    return out.select(name, F.coalesce("n_others", F.lit(0)).cast("long").alias("n_others"), F.coalesce(others, F.array().cast(f"array<{dict(groups.dtypes)[name]}>")).alias("others"))


def smallest(items: DataFrame, keys: list[str], value: str, most: int) -> DataFrame:
    """(keys, first): the `most` smallest values of each group: by parts of a group first, then over the parts."""
    parts = items.select(*keys, value, F.pmod(F.xxhash64(value), F.lit(64)).alias("__part"))
    for more in (["__part"], []):
        rank = F.row_number().over(W.partitionBy(*keys, *more).orderBy(value))
        parts = parts.withColumn("__rank", rank).where(F.col("__rank") <= most)
    return parts.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("first"))


def fill(needed: DataFrame, present: DataFrame, members: DataFrame, need: list[str], content: list[str], path: str) -> DataFrame:
    """(need, content, path): what is needed and not present, and the first path of `members` that has its content, else
    null."""
    missing = needed.select(*need, *content).distinct().join(present, [*need, *content], "left_anti")
    first = members.groupBy(*content).agg(F.min(path).alias(path))
    return missing.join(first, content, "left")


def donors(wanting: DataFrame, giving: DataFrame, alike: list[str], key: str, name: str) -> DataFrame:
    """(key, donor): of the givers that are alike the one of the same name, else the first; null if there is none.

    Givers are reduced to the first of each name and the first of all before the join, so no pairs are made.
    """
    named = giving.groupBy(*alike, name).agg(F.min(key).alias("__same"))
    first = giving.groupBy(*alike).agg(F.min(key).alias("__any"))
    out = wanting.join(named, [*alike, name], "left").join(first, alike, "left")
    return out.select(key, F.coalesce("__same", "__any").alias("donor"))


def within(points: DataFrame, spans: DataFrame, keys: list[str], at: str, begin: str, end: str) -> DataFrame:
    """Pairs of rows of `points` and `spans` of equal keys with begin <= at <= end, as one equi-join.

    A span is put under the one or two cells of its own width that it touches, a width being a power of two; a point
    under its cell of each width that occurs (63 at most). So neither long nor short spans multiply. Integers only.
    """
    width = F.greatest(F.length(F.bin(F.col(end) - F.col(begin))), F.lit(1))
    sized = spans.where(F.col(begin) <= F.col(end)).withColumn("__level", width)
    levels = [r[0] for r in sized.select("__level").distinct().collect()]
    cell = lambda x, level: F.floor(x / F.pow(F.lit(2.0), level)).cast("long")
    placed = sized.withColumn("__cell", F.explode(F.sequence(cell(F.col(begin), F.col("__level")), cell(F.col(end), F.col("__level")))))
    dealt = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("__cell", cell(F.col(at), F.col("__level")))
    return placed.join(dealt, [*keys, "__level", "__cell"]).where(F.col(at).between(F.col(begin), F.col(end))).drop("__level", "__cell")


def call_coverage(calls: DataFrame, files: DataFrame, call: str, sample: str) -> DataFrame:
    """(have, calls): calls of which all, some or none of the samples have a file."""
    held = calls.select(call, sample).join(files.select(sample).distinct().withColumn("__has", F.lit(1)), sample, "left")
    each = held.groupBy(call).agg(F.count("__has").alias("h"), F.count("*").alias("n"))
    have = F.when(F.col("h") == 0, "none").when(F.col("h") == F.col("n"), "all").otherwise("some")
    return each.groupBy(have.alias("have")).agg(F.count("*").alias("calls"))


def localized(entries: DataFrame, sample: str, lang: str, script: str, languages: int) -> DataFrame:
    """Samples whose languages differ in script, a missing language being different."""
    found = entries.groupBy(sample).agg(F.count_distinct(lang).alias("n"), F.min(script).alias("a"), F.max(script).alias("b"))
    return found.where((F.col("n") < languages) | (F.col("a") != F.col("b"))).select(sample)


def dead_boards(results: DataFrame, samples: DataFrame, board: str, at: str, sounded: Column, heard: Column) -> DataFrame:
    """(board, last_sound, dead_from, silent_after): boards all of whose replays stayed silent, with a silent tail."""
    silent = samples.groupBy(board).agg(F.bool_or(heard).alias("__any")).where(~F.col("__any")).select(board)
    mine = results.join(silent, board).withColumn("__on", sounded)
    last = mine.where("__on").groupBy(board).agg(F.max(at).alias("last_sound"))
    tail = mine.join(last, board).where(F.col(at) > F.col("last_sound"))
    return tail.groupBy(board, "last_sound").agg(F.min(at).alias("dead_from"), F.count("*").alias("silent_after"))


def duck_phases(levels: DataFrame, keys: list[str], at: str, level: str) -> DataFrame:
    """(keys, start, full, peak, ends, release): of a series of levels the first that is not zero, the first extreme and
    its value, where it is zero again, and where it first leaves the extreme; null where it never does. By sums alone."""
    top = F.max(F.when(F.col(level) != 0, F.struct(F.abs(F.col(level)).alias("a"), (-F.col(at)).alias("o"), F.col(level).alias("v"))))
    peak = levels.groupBy(*keys).agg(F.min(F.when(F.col(level) != 0, F.col(at))).alias("start"), top.alias("t"))
    peak = peak.where("t is not null").select(*keys, "start", (-F.col("t.o")).alias("full"), F.col("t.v").alias("peak"))
    tail = levels.join(peak, keys).where(F.col(at) >= F.col("full"))
    return tail.groupBy(*keys, "start", "full", "peak").agg(F.min(F.when(F.col(level) == 0, F.col(at))).alias("ends"), F.min(F.when(F.col(level) != F.col("peak"), F.col(at))).alias("release"))


def needed_names(wanted: DataFrame, upstream: DataFrame, inherited: DataFrame, keys: list[str], parent: list[str], differs: Column) -> DataFrame:
    """Wanted entries that upstream lacks and that the parent lacks too or has under a name that `differs`, a condition
    on wanted columns and `__name`, the parent's."""
    left = wanted.join(upstream.select(*keys).distinct(), keys, "left_anti")
    mother = inherited.select(*[F.col(c).alias(f"__{i}") for i, c in enumerate(keys)], F.col("name").alias("__name"), F.lit(True).alias("__listed"))
    on = [F.col(c) == F.col(f"__{i}") for i, c in enumerate(parent)]
    found = left.join(mother, on, "left").where(F.col("__listed").isNull() | differs)
    return found.drop("__name", "__listed", *[f"__{i}" for i in range(len(keys))])


def read_back(wrote: DataFrame, read: DataFrame, key: str, name: str) -> DataFrame:
    """(state, n): what a reader makes of what was written: same, misnamed, missing, or foreign."""
    one = wrote.select(key, F.col(name).alias("__a"), F.lit(True).alias("__w"))
    other = read.select(key, F.col(name).alias("__b"), F.lit(True).alias("__r"))
    state = F.when(F.col("__r").isNull(), "missing").when(F.col("__w").isNull(), "foreign").when(F.col("__a").eqNullSafe(F.col("__b")), "same").otherwise("misnamed")
    return one.join(other, key, "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def upsert(stored: DataFrame, edits: DataFrame, key: str, neutral: Column) -> DataFrame:
    """`stored` with the rows of `edits` in place of those under the same key; rows that are `neutral` then are dropped."""
    kept = stored.join(edits.select(key), key, "left_anti")
    return kept.unionByName(edits).where(~F.coalesce(neutral, F.lit(False)))


def first_place(places: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """(keys, order, value): the first place in order that has a value, as an argument is resolved along a path."""
    found = places.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(F.struct(order, value)).alias("b"))
    return found.select(*keys, f"b.{order}", f"b.{value}")
