"""Sampled series as rows: lags, loudest windows, gains of a mix, held ends. All by joins and partial sums on arithmetic
cells, so a long series is many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.spans import CHUNK, along, spread

#: Rows of a block in which neighbours are looked up.
BLOCK = 4096


def lag_pairs(items: DataFrame, keys: list[str], at: str, value: str, lags: int, block: int = BLOCK) -> DataFrame:
    """(keys, lag, at, before, value): each row with the ones 1 to `lags` places before it; `at` is that of the earlier.

    Places are dealt in blocks of `block`; the last `lags` places of a block are in the next one as well, so a window of
    a block sees all it needs and no key is one task.
    """
    size = max(block, lags)
    own = F.expr(f"`{at}` div {size}").alias("__own")
    rows = items.select(*keys, F.col(at).alias("__at"), F.col(value).alias("__v"), own)
    again = F.when(F.pmod("__at", F.lit(size)) >= size - lags, F.array(F.col("__own"), F.col("__own") + 1)).otherwise(F.array("__own"))
    rows = rows.withColumn("__block", F.explode(again))
    back = W.partitionBy(*keys, "__block").orderBy("__at").rangeBetween(-lags, -1)
    seen = rows.withColumn("__back", F.collect_list(F.struct(F.col("__at").alias("i"), F.col("__v").alias("v"))).over(back)).where("__block = __own")
    pairs = seen.select(*keys, "__at", "__v", F.explode("__back").alias("p"))
    return pairs.select(*keys, (F.col("__at") - F.col("p.i")).cast("int").alias("lag"), F.col("p.i").alias("at"), F.col("p.v").alias("before"), F.col("__v").alias("value"))


def repeat_lags(levels: DataFrame, keys: list[str], at: str, value: str, most: int, least: int = 1, confirm: int = 1, limit: float = 0.2, candidates: int = 16, block: int = BLOCK) -> DataFrame:
    """(keys, lag, diff, rank): lags at which the end of a series of levels looks like what came one lag before it.

    Levels: a row for each place from 0 on without gaps. For each lag from `least` to `most` that fits twice, the span
    compared is the lag, `confirm` places at least; diff is the sum of differences over the sum of levels. Of the lags
    within `limit`, and within three times the best or 0.01 of it, the local minima are kept (of a run of equal values the
    first), the `candidates` shortest of them.
    """
    sizes = levels.groupBy(*keys).agg((F.max(at) + 1).alias("__k"))
    pairs = lag_pairs(levels, keys, at, value, most, block).where(F.col("lag") >= least).join(sizes, keys)
    from_ = F.col("__k") - F.col("lag") - F.greatest("lag", F.lit(confirm))
    pairs = pairs.where((from_ >= 0) & (F.col("at") >= from_))
    diff = F.sum(F.abs(F.col("before") - F.col("value"))) / (F.sum(F.col("before") + F.col("value")) + F.lit(1e-9))
    curve = pairs.groupBy(*keys, "lag").agg(diff.alias("diff"))
    best = curve.groupBy(*keys).agg(F.min("diff").alias("__best"))
    by = W.partitionBy(*keys).orderBy("lag")
    near = curve.withColumn("__left", F.lag("diff").over(by)).withColumn("__right", F.lead("diff").over(by)).join(best, keys)
    bound = F.least(F.lit(limit), F.greatest(3 * F.col("__best"), F.col("__best") + 0.01))
    dip = F.coalesce(F.col("__left") > F.col("diff"), F.lit(True)) & F.coalesce(F.col("__right") >= F.col("diff"), F.lit(True))
    found = near.where((F.col("diff") <= bound) & dip).withColumn("rank", F.row_number().over(by))
    return found.where(F.col("rank") <= candidates).select(*keys, "lag", "diff", "rank")


def loudest_window(samples: DataFrame, keys: list[str], at: str, value: str, length: int, last: int, spare: int = 0) -> DataFrame:
    """(keys, begin, energy): the window of `length` places of the most energy among those that begin within the `last`
    places before the latest possible one and `spare` places before the end; of equals the latest. Windows begin every half
    length, and one at the latest possible place. Series that are too short have none. Samples: places from 0 on without gaps.
    """
    hop = max(1, length // 2)
    ends = samples.groupBy(*keys).agg((F.max(at) + 1 - spare - length).alias("__end")).where("__end >= 0")
    ends = ends.withColumn("__from", F.greatest(F.col("__end") - last, F.lit(0)))
    rows = samples.join(ends, keys).where((F.col(at) >= F.col("__from")) & (F.col(at) < F.col("__end") + length))
    # The hops whose window holds a place: from the first that has not ended to the last that has begun, up to the end.
    gone = F.col(at) - F.col("__from")
    first = F.greatest(F.ceil((gone - length + 1) / hop), F.lit(0)).cast("long")
    upto = F.least(F.floor(gone / hop), F.floor((F.col("__end") - F.col("__from")) / hop)).cast("long")
    hops = F.when(first <= upto, F.transform(F.sequence(first, upto), lambda j: F.col("__from") + j * hop)).otherwise(F.array().cast("array<long>"))
    final = F.when(F.col(at) >= F.col("__end"), F.array(F.col("__end").cast("long"))).otherwise(F.array().cast("array<long>"))
    parts = rows.select(*keys, F.explode(F.array_distinct(F.concat(hops, final))).alias("begin"), (F.col(value) * F.col(value)).alias("__e"))
    windows = parts.groupBy(*keys, "begin").agg(F.sum("__e").alias("energy"))
    return windows.groupBy(*keys).agg(F.max(F.struct("energy", "begin")).alias("b")).select(*keys, "b.begin", "b.energy")


def decibels(gain: Column) -> Column:
    """A gain in dB, -120 at least; null for none."""
    return F.when(gain.isNotNull(), 20 * F.log10(F.greatest(F.abs(gain), F.lit(1e-6))))


def mix_gains(mixes: DataFrame, keys: list[str], at: str, mix: str, music: str, other: str, width: int) -> DataFrame:
    """(keys, window, music_db, other_db, residual_db): how loud two aligned signals are in a mix of them, by least
    squares in whole windows of `width` places from 0 on.

    The normal equations are sums, so windows are partial aggregates. Where the other signal has less than a thousandth of
    the music's energy, or the two can't be told apart, the music alone is fitted and other_db is null. residual_db is what
    neither explains, relative to the mix, -120 at least.
    """
    a, b, y = F.col(music).cast("double"), F.col(other).cast("double"), F.col(mix).cast("double")
    sums = {"aa": a * a, "bb": b * b, "ab": a * b, "ay": a * y, "by": b * y, "yy": y * y}
    s = mixes.withColumn("window", F.expr(f"`{at}` div {width}")).groupBy(*keys, "window").agg(F.count("*").alias("n"), *[F.sum(v).alias(k) for k, v in sums.items()]).where(F.col("n") == width)
    aa, bb, ab, ay, by, yy = map(F.col, sums)
    det = aa * bb - ab * ab
    alone = (bb < 1e-3 * aa) | (F.abs(det) < 1e-12)
    s = s.withColumns({"gm": F.when(alone, ay / F.greatest(aa, F.lit(1e-9))).otherwise((ay * bb - by * ab) / det), "gc": F.when(~alone, (by * aa - ay * ab) / det)})
    gm, gc = F.col("gm"), F.coalesce("gc", F.lit(0.0))
    left = F.greatest(yy - 2 * gm * ay - 2 * gc * by + gm * gm * aa + 2 * gm * gc * ab + gc * gc * bb, F.lit(0.0))
    residual = 10 * F.log10(F.greatest(left / F.greatest(yy, F.lit(1e-9)), F.lit(1e-12)))
    return s.select(*keys, "window", decibels(gm).alias("music_db"), decibels(F.col("gc")).alias("other_db"), residual.alias("residual_db"))


def best_lag(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, most: int, first: int) -> DataFrame:
    """(keys, lag): by how many places, up to `most` either way, `right` comes after `left`: the lag of the largest sum of
    products over the first `first` places of `left`, the least lag of equals.

    A left place meets the right ones of its own cell of 2 * most + 1 places and the two beside it, so the join is by cells;
    products of a lag are partial sums.
    """
    size = 2 * most + 1
    a = left.where(F.col(at) < first).select(*keys, F.col(at).alias("__i"), F.col(value).alias("__a"), F.expr(f"`{at}` div {size}").alias("__c"))
    b = right.select(*keys, F.col(at).alias("__j"), F.col(value).alias("__b"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.expr(f"`{at}` div {size}") + d)).alias("__c"))
    met = a.join(b, [*keys, "__c"]).withColumn("lag", (F.col("__j") - F.col("__i")).cast("int")).where(F.abs("lag") <= most)
    sums = met.groupBy(*keys, "lag").agg(F.sum(F.col("__a") * F.col("__b")).alias("s"))
    return sums.groupBy(*keys).agg(F.min(F.struct((-F.col("s")).alias("s"), "lag")).alias("b")).select(*keys, "b.lag")


def idle_levels(chunks: DataFrame, keys: list[str], order: str, low: str, high: str, silence: int) -> DataFrame:
    """`chunks` with `idle`, the idle level that holds in each: the middle of the last chunk up to it, itself included,
    whose span is no more than twice `silence`; 0 before there is one."""
    middle = F.when(F.col(high) - F.col(low) <= 2 * silence, ((F.col(low) + F.col(high)) / 2).cast("int"))
    filled = along(spread(chunks, keys, [order]), keys, [order], lasts={"idle": middle})
    return filled.withColumn("idle", F.coalesce("idle", F.lit(0))).drop(CHUNK)


def held_end(frames: DataFrame, keys: list[str], at: str, levels: list[str], gap: int, hold: int, burst: int, silence: int = 2, span: int = 16, deviation: float = 1.0) -> DataFrame:
    """(keys, cut): where a series that ends on held levels really ends: walked back from its end over steps from one held
    level to the next, it is where the first of those levels begins; the place after its last one if it doesn't end so.

    Frames: places from 0 on without gaps, a column of whole numbers for each channel. A frame moves if a channel differs
    from the frame before by over twice `silence`; moving frames at most `gap` apart are one burst. A burst is a step if it
    is no longer than `burst`, follows the one before by more than `hold`, if all channels kept their level between
    (a range of `span` and a standard deviation of `deviation` at most), and if the level after it differs from the one
    before: a click that comes back is no step. The walk ends at the last burst that is none.

    Bursts are numbered by running sums over ranges of a hot series; what is between two bursts is summed up by its number
    alone (counts, ranges, sums and sums of squares), so no stretch has to be in one task.
    """
    rows = along(spread(frames, keys, [at]), keys, [at], lags={f"__was_{c}": F.col(c) for c in levels})
    moves = reduce(lambda x, y: x | y, [F.coalesce(F.abs(F.col(c) - F.col(f"__was_{c}")) > 2 * silence, F.lit(False)) for c in levels])
    rows = rows.select(*keys, at, *levels, *([CHUNK] if CHUNK in rows.columns else []), moves.alias("__moves"))
    rows = along(rows.withColumn("__last", F.when(F.col("__moves"), F.col(at))), keys, [at], lasts={"__upto": F.col("__last")})
    rows = along(rows, keys, [at], lags={"__before": F.col("__upto")})
    starts = F.col("__moves") & F.coalesce(F.col(at) - F.col("__before") > gap, F.lit(True))
    rows = along(rows.withColumn("__new", starts.cast("int")), keys, [at], sums={"__k": F.col("__new")})
    bursts = rows.where("__moves").groupBy(*keys, "__k").agg(F.min(at).alias("start"), F.max(at).alias("last"))
    level = F.struct(*levels)
    # After burst k, from its last moving frame on, until the next one begins.
    rest = rows.where((F.col("__k") > 0) & (F.col(at) >= F.col("__upto")))
    still = rest.join(bursts.select(*keys, "__k", "last"), [*keys, "__k"]).where(F.col(at) >= F.col("last"))
    kept = [F.count("*").alias("n"), F.max_by(level, F.col(at)).alias("end"), F.min_by(level, F.when(F.col(at) > F.col("last"), F.col(at))).alias("after")]
    for i, c in enumerate(levels):
        v = F.col(c).cast("long")
        kept += [F.max(v).alias(f"max{i}"), F.min(v).alias(f"min{i}"), F.sum(v).alias(f"sum{i}"), F.sum(v * v).alias(f"sq{i}")]
    held = still.groupBy(*keys, "__k").agg(*kept)
    n = F.col("n").cast("double")
    flat = [(F.col(f"max{i}") - F.col(f"min{i}") <= span) & (F.sqrt(n * F.col(f"sq{i}") - F.col(f"sum{i}").cast("double") * F.col(f"sum{i}")) / n <= deviation) for i in range(len(levels))]
    held = held.withColumn("flat", reduce(lambda x, y: x & y, flat)).select(*keys, "__k", "flat", "end", F.coalesce("after", "end").alias("after"))
    both = bursts.join(held, [*keys, "__k"])
    earlier = both.select(*keys, (F.col("__k") + 1).alias("__k"), F.col("last").alias("was"), F.col("flat").alias("was_flat"), F.col("end").alias("was_end"))
    both = both.join(earlier, [*keys, "__k"], "left")
    differs = reduce(lambda x, y: x | y, [F.abs(F.col("was_end")[c] - F.col("after")[c]) > 2 * silence for c in levels])
    step = (F.col("last") - F.col("start") <= burst) & (F.col("start") - F.col("was") > hold) & F.col("was_flat") & differs
    both = both.withColumn("__ok", F.coalesce(step, F.lit(False)))
    bad = both.where(~F.col("__ok")).groupBy(*keys).agg(F.max("__k").alias("__bad"))
    cuts = both.where("__ok").join(bad, keys).where(F.col("__k") > F.col("__bad")).groupBy(*keys).agg(F.min("was").alias("__cut"))
    ends = frames.groupBy(*keys).agg((F.max(at) + 1).alias("__end"))
    return ends.join(cuts, keys, "left").select(*keys, F.coalesce("__cut", "__end").alias("cut"))
