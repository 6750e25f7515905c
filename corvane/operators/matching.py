"""Matching: identification of files, tiers, covers, subsets, universal and band joins."""

from __future__ import annotations

import itertools
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators import spans
from corvane.session import discard, stored


#: Members of a unit and files of a set up to which they travel as a list; beyond, pairs are told apart by a shuffle.
LISTED = 32

#: Rows of units, and of sets, that meet in a task; the sets are held in its memory. Tokens are counted by so many buckets.
UNITS_OF_A_TASK, SETS_OF_A_TASK, BUCKETS = 100_000, 10_000, 16_384

#: Rows that a task should sort or hold at once, about a page of Spark's memory.
ROWS_OF_A_TASK = 500_000

#: Counted rows up to which a side is broadcast.
BROADCAST_ROWS = 100_000


def _name_token() -> Column:
    return F.concat(F.lit("n"), F.lower("name"))


def _content_token() -> Column:
    return F.concat(F.lit("x"), F.col("size").cast("string"), F.lit(":"), F.col("crc").cast("string"))


def _of_member() -> Column:
    """What a file of a set may be found by: the name and the content of a member."""
    return F.array(_name_token(), _content_token())


def _of_file() -> Column:
    """What a file is found by: its content or, if it was never dumped, its name."""
    return F.array(F.when(F.col("no_dump"), _name_token()).when(~F.col("no_dump"), _content_token()))


def _tokens(rows: DataFrame, key: str, of: Column) -> DataFrame:
    return rows.select(key, F.explode(of).alias("token")).where("token is not null")


def _parted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """`rows` of keys with up to LISTED rows, and those of larger keys, if any."""
    sizes = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__rows")).where(F.col("__rows") > LISTED)
    if sizes.isEmpty():
        return rows, None
    same = F.col(key).eqNullSafe(F.col("__key"))
    return rows.join(sizes, same, "left_anti"), rows.join(sizes, same, "left_semi")


def _distinct_tokens() -> Column:
    return F.array_distinct(F.array_compact(F.concat("__names", "__contents")))


def _bits(token: Column) -> Column:
    """Two bits of 64 that a token sets: it is not among tokens that leave one unset."""
    h = F.xxhash64(token)
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(63).cast("int"))
    return bit(h).bitwiseOR(bit(F.shiftright(h, 6)))


def _units(members: DataFrame) -> DataFrame:
    """(unit, __names, __contents, __ords, __bits): the tokens of a unit's members, by their order, and the bits that they set,
    none for a null unit. Stored, as it is read twice."""
    entry = F.struct("ord", _name_token().alias("n"), _content_token().alias("x"))
    found = members.groupBy("unit").agg(F.sort_array(F.collect_list(entry)).alias("__m"))
    found = found.select("unit", F.col("__m.n").alias("__names"), F.col("__m.x").alias("__contents"), F.col("__m.ord").alias("__ords"))
    bits = F.aggregate(_distinct_tokens(), F.lit(0).cast("long"), lambda all, token: all.bitwiseOR(_bits(token)))
    return stored(found.withColumn("__bits", F.when(F.col("unit").isNotNull(), bits).otherwise(0)), "units")


def _sets(files: DataFrame, **lists: Column) -> DataFrame:
    """(set, lists, token, __before): each token that a set is found by with its smaller ones, and lists over all its files."""
    every = F.sort_array(F.array_distinct(F.array_compact(F.flatten(F.collect_list(_of_file())))))
    found = files.groupBy("set").agg(every.alias("__all"), *[F.collect_list(c).alias(n) for n, c in lists.items()])
    found = found.select("set", *lists, "__all", F.posexplode("__all").alias("__at", "token"))
    return found.select("set", *lists, "token", F.slice("__all", F.lit(1), F.col("__at")).alias("__before"))


def _met(units: DataFrame, sets: DataFrame, held: list[str]) -> DataFrame:
    """Units, under each of their tokens, and sets (by `_sets`) that share one, each pair once: where no smaller token is shared
    as well. `held` are a unit's lists of its tokens, or of the smaller ones.

    Pairs can be many times the rows of both, so none is shuffled to be told from its repeats, and no side is broadcast:
    rows meet in tasks by their token. Rows of each bucket of tokens are counted first; of one with too many for a task both
    sides are parted, and each part of one meets each part of the other."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(BUCKETS)).cast("int")
    sides = {"unit": (units, UNITS_OF_A_TASK), "set": (sets, SETS_OF_A_TASK)}
    counts = {key: dict(rows.groupBy(bucket.alias("b")).count().collect()) for key, (rows, _) in sides.items()}
    tasks = max(units.sparkSession.sparkContext.defaultParallelism, *[-(-sum(counts[key].values()) // most) for key, (_, most) in sides.items()])
    parts = {key: [-(-counts[key].get(b, 0) // most) for b in range(BUCKETS)] for key, (_, most) in sides.items()}
    on = ["token"]
    if max(map(max, parts.values())) > 1:
        on += ["__part_unit", "__part_set"]
        of = {key: F.get(F.split(F.lit(",".join(map(str, n))), ",").cast("array<long>"), bucket) for key, n in parts.items()}
        for key, other in (("unit", "set"), ("set", "unit")):
            rows, most = sides[key]
            rows = rows.where(of[other] > 0).withColumn(f"__part_{key}", F.pmod(F.xxhash64(key), of[key]) + 1)
            sides[key] = rows.withColumn(f"__part_{other}", F.explode(F.sequence(F.lit(1).cast("long"), of[other]))), most
    left, right = (sides[key][0].repartition(tasks, *on) for key in ("unit", "set"))
    both = left.join(right.hint("shuffle_hash"), on)
    return reduce(lambda pairs, tokens: pairs.where(~F.coalesce(F.arrays_overlap(tokens, "__before"), F.lit(False))), held, both)


def _shuffled(few: DataFrame, many: DataFrame | None, files: DataFrame, many_files: DataFrame | None) -> DataFrame | None:
    """(unit, set): the pairs with a unit or a set that is too large for a list; None if there is none."""
    sides = [(many, files), (few, many_files)]
    parts = [_tokens(u, "unit", _of_member()).join(_tokens(s, "set", _of_file()).hint("merge"), "token") for u, s in sides if u is not None and s is not None]
    return reduce(DataFrame.unionByName, [p.select("unit", "set").distinct() for p in parts]) if parts else None


def candidates(members: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, set): sets that share a file with a unit: by crc and size, or by name for files that were never dumped.

    Members: unit, ord, name, crc, size. Files: set, name, crc, size, no_dump. One equi-join on what files are found by; its
    rows are the result, as a pair that shares several is listed at the first of them.
    """
    (few, many), (few_files, many_files) = _parted(members, "unit"), _parted(files, "set")
    units = _units(few).select("unit", F.sort_array(_distinct_tokens()).alias("__all"))
    units = units.select("unit", "__all", F.posexplode("__all").alias("__at", "token"))
    units = units.select("unit", "token", F.slice("__all", F.lit(1), F.col("__at")).alias("__held"))
    pairs = _met(units, _sets(few_files), ["__held"]).select("unit", "set")
    rest = _shuffled(few, many, files, many_files)
    return pairs if rest is None else pairs.unionByName(rest)


def match_candidates(members: DataFrame, files: DataFrame) -> DataFrame:
    """What `match_files` gives for `candidates`, where `ord` is one file of a set. A unit and a set bring the lists of their
    files to where they meet, so neither the pairs nor their files are shuffled; those too large for a list are matched by
    joins."""
    (few, many), (few_files, many_files) = _parted(members, "unit"), _parted(files, "set")
    content = F.when(~F.col("no_dump"), _content_token())
    no_dump = F.coalesce("no_dump", F.lit(False)).alias("no_dump")
    want = F.struct("ord", _name_token().alias("n"), _bits(_name_token()).alias("bn"), content.alias("x"), _bits(content).alias("bx"), no_dump)
    units = _units(few).withColumn("token", F.explode(_distinct_tokens()))
    pairs = _met(units, _sets(few_files, __want=want), ["__names", "__contents"]).where("set is not null")
    found = pairs.select("unit", "set", "__names", "__contents", "__bits", "__ords", F.explode("__want").alias("f"))
    # Places in the lists of a unit, whose members are in order; 0 if there is none. Most files are none of the unit's, and are
    # told by their bits before texts are compared.
    at = lambda tokens, token, bits: F.when(F.col("__bits").bitwiseAND(bits) == bits, F.coalesce(F.array_position(tokens, token), F.lit(0))).otherwise(0)
    n, x = at("__names", F.col("f.n"), F.col("f.bn")), at("__contents", F.col("f.x"), F.col("f.bx"))
    found = found.select("unit", "set", "f.ord", "f.no_dump", "f.n", "f.x", "__names", "__contents", "__ords", n.alias("__n"), x.alias("__x"))
    # Only where the content is there: a member of that content under that name.
    same = F.array_position(F.arrays_zip(F.col("__contents").alias("x"), F.col("__names").alias("n")), F.struct("x", "n"))
    found = found.withColumn("__b", F.when((F.col("__x") > 0) & (F.col("__n") > 0), same).otherwise(0))
    status = F.when((F.col("__b") > 0) | (F.col("no_dump") & (F.col("__n") > 0)), "good").when(F.col("__x") > 0, "renamed").when(F.col("__n") > 0, "wrong").otherwise("missing")
    first = F.when(F.col("__b") > 0, F.col("__b")).when(F.col("__x") > 0, F.col("__x")).when(F.col("__n") > 0, F.col("__n"))
    found = found.select("unit", "set", "ord", status.alias("status"), F.get("__ords", (first - 1).cast("int")).alias("member"))
    rest = _shuffled(few, many, files, many_files)
    return found if rest is None else found.unionByName(match_files(rest, members, files))


def match_files(pairs: DataFrame, members: DataFrame, files: DataFrame) -> DataFrame:
    """(unit, set, ord, status, member): for each file of a candidate set the member that is it: good under its own
    name, renamed under another, wrong if only the name is its own, else missing. The first member wins; a member may
    be several files."""
    want = pairs.join(files.hint("merge"), "set").select("unit", "set", "ord", F.lower("name").alias("__n"), "crc", "size", "no_dump")
    have = members.select("unit", F.col("ord").alias("m"), F.lower("name").alias("mn"), F.col("crc").alias("mc"), F.col("size").alias("ms"))
    same = want.where("not no_dump").join(have, (want["unit"] == have["unit"]) & (F.col("crc") == F.col("mc")) & (F.col("size") == F.col("ms"))).drop(have["unit"])
    same = same.withColumn("tier", F.when(F.col("__n") == F.col("mn"), 0).otherwise(1))
    named = want.join(have, (want["unit"] == have["unit"]) & (F.col("__n") == F.col("mn"))).drop(have["unit"])
    named = named.withColumn("tier", F.when(F.col("no_dump"), 0).otherwise(2))
    best = same.unionByName(named).groupBy("unit", "set", "ord").agg(F.min(F.struct("tier", "m")).alias("b"))
    status = F.when(F.col("b.tier") == 0, "good").when(F.col("b.tier") == 1, "renamed").when(F.col("b.tier") == 2, "wrong").otherwise("missing")
    out = want.select("unit", "set", "ord").join(best, ["unit", "set", "ord"], "left")
    return out.select("unit", "set", "ord", status.alias("status"), F.col("b.m").alias("member"))


def closest(matched: DataFrame) -> DataFrame:
    """(unit, set, found, bad): the set of most found files, then of fewest wrong or missing ones, then by name."""
    found = matched.groupBy("unit", "set").agg(F.count_if(F.col("status").isin("good", "renamed")).alias("found"), F.count_if(F.col("status").isin("wrong", "missing")).alias("bad"))
    best = found.groupBy("unit").agg(F.min(F.struct((-F.col("found")).alias("o"), "bad", "set", "found")).alias("b"))
    return best.select("unit", "b.set", "b.found", "b.bad")


def closest_sets(members: DataFrame, files: DataFrame) -> DataFrame:
    """What `closest` gives for all candidate sets, without matching their files one by one or listing all pairs.

    A file is found by one token, its content or its name; a set's found files are those of the tokens it shares. A set
    that shares only its most frequent token has the same figures for each unit, so the best of these sets is one row a
    token. A set that shares others too is met by one of those, which few units have, and is counted whole. Where it is also listed by
    its most frequent token alone, that is less than it has and cannot come first.
    """
    # Tables made from few bytes of files can have many rows: none is broadcast by its guessed size.
    met = lambda rows: rows.hint("merge")
    have = _tokens(members, "unit", _of_member()).distinct()
    often = have.groupBy("token").agg(F.count("*").alias("__often"))
    sizes = files.groupBy("set").agg(F.count("*").alias("__size"))
    want = _tokens(files, "set", _of_file()).groupBy("set", "token").agg(F.count("*").alias("n")).join(met(often), "token").join(met(sizes), "set")
    top = want.groupBy("set", "__size").agg(F.max(F.struct("__often", "token", "n")).alias("t")).select("set", "__size", "t.token", "t.n")
    rank = lambda found: F.struct((-found).alias("o"), (F.col("__size") - found).alias("bad"), "set", found.alias("found"))
    alone = have.join(met(top.groupBy("token").agg(F.min(rank(F.col("n"))).alias("b"))), "token").select("unit", "b")
    light = want.join(met(top), ["set", "token"], "left_anti").select("set", "token", "n")
    some = have.join(met(light), "token").groupBy("unit", "set").agg(F.sum("n").alias("__light")).join(met(top), "set")
    held = have.select(F.col("unit").alias("__u"), F.col("token").alias("__t"))
    some = some.join(met(held), F.col("unit").eqNullSafe(F.col("__u")) & (F.col("token") == F.col("__t")), "left")
    several = some.select("unit", rank(F.col("__light") + F.when(F.col("__t").isNotNull(), F.col("n")).otherwise(0)).alias("b"))
    best = alone.unionByName(several).groupBy("unit").agg(F.min("b").alias("b"))
    return best.select("unit", "b.set", "b.found", "b.bad")


def supplier_of(needs: DataFrame, chain: DataFrame, holds: DataFrame, keys: list[str], need: str) -> DataFrame:
    """(keys, need, supplier): for each need the first unit of its chain that holds it; null if none does.

    Chain: keys, unit, ord. Holds: unit, need. As a unit that has a need takes it from all later ones, the minimum of
    the order is the same as walking the chain.
    """
    found = needs.join(chain, keys).join(holds, ["unit", need]).groupBy(*keys, need).agg(F.min(F.struct("ord", "unit")).alias("b"))
    return needs.join(found, [*keys, need], "left").select(*keys, need, F.col("b.unit").alias("supplier"))


def first_tier(items: DataFrame, lookups: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """`items` with `value` and `tier` from the first lookup that has it; lookups are unique by their keys."""
    out, values, tiers = items, [], []
    for i, (name, df, keys) in enumerate(lookups):
        out = out.join(df.select(*keys, F.col(value).alias(f"__v{i}")), keys, "left")
        values.append(F.col(f"__v{i}"))
        tiers.append(F.when(F.col(f"__v{i}").isNotNull(), name))
    return out.select(*items.columns, F.coalesce(*values).alias(value), F.coalesce(*tiers).alias("tier"))


def prefixes_of(names: DataFrame, headings: DataFrame) -> DataFrame:
    """(name, heading): names of which a heading is a true beginning: prefixes are exploded and joined by equality, so
    the cost follows the names' lengths and not the product of both tables."""
    cut = names.where(F.length("name") > 1).withColumn("heading", F.explode(F.transform(F.sequence(F.lit(1), F.length("name") - 1), lambda n: F.left("name", n))))
    return cut.join(headings.select("heading").distinct(), "heading").select("name", "heading")


def universal(readers: DataFrame, entries: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys): keys whose entries hold every `value` of `readers`: counted, not divided pair by pair."""
    wanted = readers.select(value).distinct()
    total = wanted.agg(F.count("*").alias("__all"))
    has = entries.select(*keys, value).distinct().join(wanted, value).groupBy(*keys).agg(F.count("*").alias("__n"))
    return has.join(F.broadcast(total), F.col("__n") == F.col("__all")).select(*keys)  # one row


def band(items: DataFrame, keys: list[str], bands: list[tuple[str, float]], order: str, also: tuple[list[str], Callable] | None = None) -> DataFrame:
    """(keys, a, b): pairs a < b by `order` of a group whose values differ by at most each band's width, and of which, if given,
    `also` holds: columns, and a test of a pair from two functions that give those of a and of b.

    Rows without a neighbour within the first band are left out before anything is copied. The values of each band fall in
    cells of its width; a row meets its own cells and the following of its neighbours by one equi-join over all bands, so what
    is close in one band alone makes no pair.
    """
    value, width = bands[0]
    rows = spans.spread(items.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, value)])), keys, [value, order])
    rows = spans.along(rows, keys, [value, order], lags={"__lag": F.col(value)}, leads={"__lead": F.col(value)})
    rows = rows.where((F.col(value) - F.col("__lag") <= width) | (F.col("__lead") - F.col(value) <= width)).select(*items.columns)
    cells = {f"__cell{i}": F.floor(F.col(v) / w) for i, (v, w) in enumerate(bands)}
    steps = [s for s in itertools.product((-1, 0, 1), repeat=len(bands)) if s >= (0,) * len(bands)]
    near_cells = F.array(*[F.struct(*[(c + by).alias(n) for (n, c), by in zip(cells.items(), s)], F.lit(any(s)).alias("__on")) for s in steps])
    left = rows.select("*", F.inline(near_cells))
    right = rows.select(*keys, *[c.alias(n) for n, c in cells.items()], F.col(order).alias("b"), *[F.col(v).alias(f"__r{i}") for i, (v, _) in enumerate(bands)], *[F.col(c).alias(f"__of_b_{c}") for c in (also[0] if also else [])])
    pairs = left.join(right, [*keys, *cells]).where(F.when(F.col("__on"), F.col(order) != F.col("b")).otherwise(F.col(order) < F.col("b")))
    near = reduce(lambda x, y: x & y, [F.abs(F.col(v) - F.col(f"__r{i}")) <= w for i, (v, w) in enumerate(bands)])
    if also:
        here, there = F.col, lambda c: F.col(f"__of_b_{c}")
        near = near & F.when(F.col(order) < F.col("b"), also[1](here, there)).otherwise(also[1](there, here))
    return pairs.where(near).select(*keys, F.least(order, "b").alias("a"), F.greatest(order, "b").alias("b"))


def leaders(pairs: DataFrame, block: list[str]) -> DataFrame:
    """(block, item, leader): each item that is a twin, and the first earlier item that is none and pairs with it.

    Pairs: block, a < b. An item with no such pair leads itself and is not listed. Order decides, so this is no
    component. Rounds of joins settle the items: one whose earlier partners are all settled as twins is none, and what
    pairs with such a one is a twin. All groups go on at once, and none of them is in one task; there are as many rounds
    as the longest chain of items that wait for each other.
    """
    node = lambda df, side: df.select(*block, F.col(side).alias("__x")).distinct()
    every = stored(pairs.select(*block, "a", "b").distinct(), "pairs")
    twins, rest = [], every
    while not rest.isEmpty():
        first = node(rest, "a").join(node(rest, "b"), [*block, "__x"], "left_anti")
        new = stored(node(rest.join(first.withColumnRenamed("__x", "a"), [*block, "a"], "left_semi"), "b"), "twins")
        left = rest.join(new.withColumnRenamed("__x", "b"), [*block, "b"], "left_anti").join(new.withColumnRenamed("__x", "a"), [*block, "a"], "left_anti")
        left = stored(left, "rest")
        twins.append(new)
        if rest is not every:
            discard(rest)
        rest = left
    found = reduce(DataFrame.unionByName, twins) if twins else node(every, "b")
    lead = every.join(found.withColumnRenamed("__x", "b"), [*block, "b"], "left_semi").join(found.withColumnRenamed("__x", "a"), [*block, "a"], "left_anti")
    return lead.groupBy(*block, F.col("b").alias("item")).agg(F.min("a").alias("leader"))


def dealt(rows: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """`rows`, of which there are about `n`, dealt by `keys` to tasks of about ROWS_OF_A_TASK. Spark merges the partitions of
    its own shuffles into a few for each core, so that a task, and its memory, grows with the table; it leaves these alone."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS_OF_A_TASK))
    return rows.repartition(tasks, *keys)


def _few(rows: DataFrame, n: int) -> DataFrame:
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def _looked_up(rows: DataFrame, n: int, table: DataFrame, of: int, keys: list[str]) -> DataFrame:
    """`rows`, `n` of them, joined by `keys` to a table of `of` rows: broadcast if they are few, else both are dealt."""
    if n <= BROADCAST_ROWS:
        return F.broadcast(rows).join(table, keys)
    return dealt(rows, max(n, of), keys).join(dealt(table, max(n, of), keys), keys)


def without_subsets(sets: DataFrame, keys: list[str], name: str, element: str) -> DataFrame:
    """(keys, name, size): sets of a group that are no true part of another of the same group.

    Sets: keys, name, element, distinct. A set can only be part of one that holds its rarest element: one with an element that
    no other has is part of none. What is left meets the larger holders of its rarest element, and for these pairs the
    common elements are counted. A null element counts in the size, and no other set needs to hold it.
    """
    over = lambda *by: F.count("*").over(Window.partitionBy(*by))
    sets = stored(sets.withColumn("__size", over(*keys, name)), "sets")
    n = sets.count()
    held = dealt(sets, n, [*keys, element]).withColumn("__n", over(*keys, element))
    rare = F.min(F.when(F.col(element).isNotNull(), F.struct("__n", element)))
    whole = dealt(held, n, [*keys, name]).groupBy(*keys, name, "__size").agg(rare.alias("__rare"), F.count(element).alias("__known"))
    whole = stored(whole, "whole")
    shared, bare = whole.agg(F.count_if(F.col("__rare.__n") > 1), F.count_if(F.col("__rare").isNull())).first()

    side = lambda to, *more: sets.select(*keys, F.col(name).alias(to), element, *more)
    # An element that many sets hold makes a large partition of pairs, so this shuffle stays Spark's own, which may split it.
    doubt = whole.where("__rare.__n > 1").select(*keys, F.col(name).alias("__a"), F.col("__size").alias("__a_size"), "__known", f"__rare.{element}")
    pairs = _few(doubt, shared).join(side("__b", F.col("__size").alias("__b_size")), [*keys, element]).where("__a_size < __b_size")
    pairs = stored(pairs.select(*keys, "__a", "__b", "__known"), "pairs")
    met, asked = pairs.agg(F.count("*"), F.coalesce(F.sum("__known"), F.lit(0))).first()
    wanted = _looked_up(pairs, met, side("__a"), n, [*keys, "__a"])
    common = _looked_up(wanted, asked, side("__b"), n, [*keys, "__b", element])
    parts = common.groupBy(*keys, "__a", "__b", "__known").agg(F.count("*").alias("__c")).where("__c = __known").select(*keys, F.col("__a").alias(name))
    if bare:  # sets of nulls alone
        largest = whole.groupBy(*keys).agg(F.max("__size").alias("__largest"))
        parts = parts.unionByName(whole.where("__rare is null").join(largest, keys).where("__size < __largest").select(*keys, name))
    return whole.join(_few(parts.distinct(), met + bare), [*keys, name], "left_anti").select(*keys, name, F.col("__size").alias("size"))


def inherit(items: DataFrame, keys: list[str], own: str, order: Column) -> DataFrame:
    """`items` with null `own` taken from the first row of the same keys that has it, and `inherited` saying so."""
    first = items.where(F.col(own).isNotNull()).groupBy(*keys).agg(F.min(F.struct(order.alias("o"), F.col(own).alias("v"))).alias("__f"))
    out = items.join(first, keys, "left")
    filled = F.coalesce(F.col(own), F.col("__f.v"))
    return out.select(*[filled.alias(c) if c == own else F.col(c) for c in items.columns], (F.col(own).isNull() & filled.isNotNull()).alias("inherited"))


def second_attempt(first: DataFrame, second: DataFrame, key: str, better: Column) -> DataFrame:
    """Rows of `first`, replaced by the row of `second` under the same key where `better` holds of it, and `retried`."""
    columns = [c for c in first.columns if c != key]
    again = second.where(better).select(key, F.struct(*columns).alias("__new"))
    tried = second.select(key, F.lit(True).alias("retried"))
    out = first.join(again, key, "left").join(tried, key, "left")
    pick = [F.when(F.col("__new").isNotNull(), F.col("__new")[c]).otherwise(F.col(c)).alias(c) for c in columns]
    return out.select(key, *pick, F.coalesce("retried", F.lit(False)).alias("retried"))


def aliases(rows: DataFrame, key: str, alias: Column) -> DataFrame:
    """`rows` and copies of them under their alias where no original has it; the smallest original owns an alias."""
    made = rows.withColumn("__alias", alias).where(F.col("__alias").isNotNull())
    rest = [c for c in rows.columns if c != key]
    made = made.groupBy(F.col("__alias").alias(key)).agg(F.min(F.struct(key, *rest)).alias("r")).join(rows.select(key), key, "left_anti")
    return rows.withColumn("is_alias", F.lit(False)).unionByName(made.select(key, *[f"r.{c}" for c in rest], F.lit(True).alias("is_alias")))


def last_rows(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: a later override replaces an earlier one."""
    rest = [c for c in rows.columns if c not in (*keys, order)]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("r"))
    return best.select(*keys, f"r.{order}", *[f"r.{c}" for c in rest])


def above_median(items: DataFrame, median: DataFrame, keys: list[str], level: str, by: float, least: int) -> DataFrame:
    """Rows over `by` above the median of their group, of groups of `least` rows or more."""
    out = items.join(median, keys).where((F.col("n") >= least) & (F.col(level) > F.col("median") + by))
    return out.select(*items.columns, "median")


def reference_of(items: DataFrame, median: DataFrame, keys: list[str], level: str, order: str) -> DataFrame:
    """(keys, reference): the row of each group that is closest to its median, the first of equals."""
    near = items.join(median, keys).groupBy(*keys).agg(F.min(F.struct(F.abs(F.col(level) - F.col("median")).alias("d"), F.col(order))).alias("b"))
    return near.select(*keys, F.col("b")[order].alias("reference"))


def required(files: DataFrame) -> DataFrame:
    """`files` (no_dump, crc) that a complete set must hold: dumped ones whose checksum is known. A null no_dump is false."""
    return files.where(~F.coalesce("no_dump", F.lit(False)) & F.col("crc").isNotNull())
