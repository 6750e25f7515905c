"""Mixing sources to target weights: tempered shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS, stored

#: Least entropy as a share of the highest, most times that a source may be repeated, tokens of a block, seed.
ENTROPY, REPEATS, BLOCK_TOKENS, SEED = 0.95, 4.0, 1_000_000, 42
#: Blocks of a source at most: larger sources have larger blocks, so blocks and the rows of one both stay few.
MOST_BLOCKS = 1 << 16
#: Bisections of the exponent, and how many are done in one pass over the sources.
STEPS, A_PASS = 40, 5
WORD = r"[^ \t\n\x0B\f\r]+"
SPAN = 4294967296.0


def tokens(text: Column) -> Column:
    """Words of a text, the measure of its size; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts) -> Column:
    """32 bits of the MD5 of the parts joined by colons, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


class Mix(NamedTuple):
    """The exponent of the source shares, the sum of the tempered shares, all tokens and the budget."""

    exponent: float
    total_power: float
    total: int
    budget: int


def temper(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None) -> Mix:
    """The largest exponent in [0, 1] whose weights, shares to its power, reach `entropy` (a share of the entropy of
    equal weights), raised to the least one that repeats no source of `sources` (tokens) over `repeats` times.

    Entropy falls and repetition rises as the exponent leaves one for zero, so both are found by bisection; a pass sums
    the powers for the midpoints of several bisections at once. Only sums come to the driver. If no exponent keeps to
    `repeats`, as with a budget beyond that many corpora, it is one: shares in proportion.
    """
    n, total, least = sources.where("tokens > 0").agg(F.count("*"), F.sum("tokens"), F.min("tokens")).first()
    total = int(total or 0)
    budget = total if budget is None else int(budget)
    if not n or n == 1:
        return Mix(1.0, 1.0, total, budget)
    share = F.col("tokens") / F.lit(float(total))

    def sums(points: list[float]) -> list[tuple[float, float]]:
        asked = [x for a in points for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share)))]
        row = sources.where("tokens > 0").agg(*[x.alias(f"c{i}") for i, x in enumerate(asked)]).first()
        return list(zip(row[::2], row[1::2]))

    def even(a: float, z: float, zlog: float) -> bool:
        return math.log(z) - a * zlog / z >= entropy * math.log(n)

    def spared(a: float, z: float, zlog: float) -> bool:
        return budget / total * (least / total) ** (a - 1) / z <= repeats

    def bisect(lower_holds: bool, holds) -> float:
        lo, hi = 0.0, 1.0
        (z0, l0), (z1, l1) = sums([0.0, 1.0])
        if lower_holds and holds(1.0, z1, l1) or not lower_holds and not holds(1.0, z1, l1):
            return 1.0
        if holds(0.0, z0, l0) != lower_holds:
            return 0.0
        for _ in range(0, STEPS, A_PASS):
            points = [lo + (hi - lo) * i / (1 << A_PASS) for i in range(1, 1 << A_PASS)]
            found = dict(zip(points, sums(points)))
            at, step = 0, 1 << A_PASS
            for _ in range(A_PASS):
                step //= 2
                a = points[at + step - 1]
                if holds(a, *found[a]) == lower_holds:
                    at += step
            ends = [lo, *points, hi]
            lo, hi = ends[at], ends[at + 1]
        return lo if lower_holds else hi

    a = max(bisect(True, even), bisect(False, spared))
    return Mix(a, sums([a])[0][0], total, budget)


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", entropy: float = ENTROPY, repeats: float = REPEATS, budget: int | None = None, block_tokens: int = BLOCK_TOKENS, most_blocks: int = MOST_BLOCKS, seed: int = SEED, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` as often as each is to be seen, with n_tokens, epoch, block and at.

    A source's weight is its tempered share (see temper), its quota that share of `budget` tokens, by default those of
    the corpus, rounded to a whole one. A quota is whole epochs over the source and a part of one more. In each epoch a source's blocks are
    permuted anew; the last one ends in the document that would exceed the quota, which stays out. `at` is how much of
    a source's quota goes before a block: documents sorted by it show the target weights all along.

    A document's block and its place there come from hashes of doc_id: rows with equal doc_id and source go together.
    Null sources are one source, null doc_ids one document. A null or empty text has no tokens; a source without
    tokens has no weight and is never shown. An empty table gives an empty table. Columns of `docs` under the four
    names are replaced. Texts are counted and filtered map-only: what is shuffled are sums by source and block, and the
    documents of the one block of each source that its quota cuts. Block sums of a source are at most `most_blocks`: a
    source of more than that many times `block_tokens` has larger blocks, and no document is left out for it.
    """
    names = [c for c in docs.columns if c not in ("n_tokens", "epoch", "block", "at")]
    src = F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n"))
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    light = stored(docs.select(key.alias("k"), src.alias("src"), tokens(F.col(text)).alias("n_tokens")), "tokens")
    sources = stored(light.groupBy("src").agg(F.sum("n_tokens").alias("tokens")).where("tokens > 0"), "sources")
    found = temper(sources, entropy, repeats, budget)
    quota = F.floor(F.pow(F.col("tokens") / F.lit(float(max(found.total, 1))), F.lit(found.exponent)) / F.lit(found.total_power) * F.lit(float(found.budget)) + 0.5).cast("long")
    plan = sources.withColumn("quota", quota).where("quota > 0")
    plan = plan.withColumn("full", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    plan = plan.withColumn("blocks", F.least(F.lit(most_blocks), F.ceil(F.col("tokens") / F.lit(float(block_tokens))).cast("long")))
    few = sources.count() <= broadcast_rows
    side = lambda df: F.broadcast(df) if few else df

    block = F.pmod(_hash(F.lit(seed), F.lit("block"), F.col("k")), F.col("blocks"))
    turn = lambda epoch: _hash(F.lit(seed), F.lit("turn"), F.col("src"), epoch, F.col("block"))
    place = lambda epoch: _hash(F.lit(seed), F.lit("place"), epoch, F.col("k"))

    # Where the part of an epoch ends: the block, then the last document that still fits.
    last = light.join(side(plan.where("rest > 0").select("src", "full", "rest", "blocks")), "src").withColumn("block", block)
    sums = last.groupBy("src", "full", "rest", "block").agg(F.sum("n_tokens").alias("tokens"))
    order = W.partitionBy("src").orderBy("turn", "block")
    sums = sums.withColumn("turn", turn(F.col("full"))).withColumn("upto", F.sum("tokens").over(order))
    cut = sums.where("upto > rest").groupBy("src").agg(F.min(F.struct("turn", "block", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))).alias("c"))
    cut = stored(cut.select("src", F.col("c.turn").alias("cut_turn"), F.col("c.block").alias("cut_block"), F.col("c.left").alias("left")), "cuts")
    inside = last.join(side(cut), "src").where("block = cut_block").groupBy("src", "left", "full", "k").agg(F.sum("n_tokens").alias("tokens"))
    inside = inside.withColumn("place", place(F.col("full"))).withColumn("upto", F.sum("tokens").over(W.partitionBy("src").orderBy("place", "k")))
    ends = inside.where("upto > left").groupBy("src").agg(F.min(F.struct("place", "k")).alias("end"))
    plan = stored(plan.join(cut.drop("left"), "src", "left").join(ends, "src", "left").select("src", "tokens", "quota", "full", "rest", "blocks", "cut_turn", "cut_block", F.col("end.place").alias("end_place"), F.col("end.k").alias("end_k")), "plan")

    inner = F.struct(*[F.col(c) for c in names]).alias("doc")
    out = docs.select(inner, key.alias("k"), src.alias("src"), tokens(F.col(text)).alias("n_tokens")).join(side(plan), "src")
    out = out.withColumn("block", block).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    out = out.withColumn("turn", turn(F.col("epoch")))
    before = F.struct("turn", "block") < F.struct(F.col("cut_turn"), F.col("cut_block"))
    ahead = F.struct(place(F.col("epoch")), F.col("k")) < F.struct(F.col("end_place"), F.col("end_k"))
    taken = (F.col("epoch") < F.col("full")) | (F.col("rest") > 0) & (before | (F.col("block") == F.col("cut_block")) & ahead)
    at = (F.col("epoch") + F.col("turn") / F.lit(SPAN)) * F.col("tokens") / F.col("quota")
    return out.where(taken).select(*[F.col("doc")[c].alias(c) for c in names], "n_tokens", "epoch", "block", at.alias("at"))
