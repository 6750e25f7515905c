"""Names: which file names which set, what applying it changes, and which reports and notes count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import exprs as X


def applied_names(sounds: DataFrame, names: DataFrame) -> DataFrame:
    """(id, state, old, name): what each id of a names file does to the sounds.

    Sounds: id (a number), name. Names: text (an id as written), ord, name. Ids are compared as numbers; ids that are
    none are left out. State: conflict where a file gives an id two names, and no name is taken; unknown where no sound
    has the id; else changed or same.
    """
    given = names.withColumn("id", X.parse_id(F.col("text"))).where("id is not null")
    given = given.groupBy("id").agg(F.min("name").alias("a"), F.max("name").alias("b"))
    both = given.join(sounds.select("id", F.col("name").alias("old"), F.lit(True).alias("known")), "id", "left")
    state = F.when(F.col("a") != F.col("b"), "conflict").when(F.col("known").isNull(), "unknown").when(F.coalesce("old", F.lit("")) != F.col("a"), "changed").otherwise("same")
    return both.select("id", state.alias("state"), "old", F.when(F.col("a") == F.col("b"), F.col("a")).alias("name"))


def name_guard(own_id: Column, pack_id: Column, own_rom: Column, pack_rom: Column, force: bool) -> Column:
    """Whether names may go on a pack: refused where both say which sounds they are for and differ, or forced; warned
    of where the ids cannot be compared and the sets differ; else ok. Ids are compared without case."""
    differ = X.ascii_lower(own_id) != X.ascii_lower(pack_id)
    return F.when(differ, "forced" if force else "refused").when(differ.isNull() & (own_rom != F.coalesce(pack_rom, F.lit("?"))), "warned").otherwise("ok")


def names_for(files: DataFrame, games: DataFrame) -> DataFrame:
    """(game, file): names files of each game: of its content, or, where a file states none, of its name or that of the
    set it was measured by. Files: file, fingerprint, rom. Games: game, measured, fingerprint, measured_fingerprint. Three
    equi-joins, not one with OR."""
    game = games.withColumn("fp", F.coalesce("fingerprint", "measured_fingerprint"))
    by_content = files.where("fingerprint is not null").select("file", F.col("fingerprint").alias("fp")).join(game, "fp").select("game", "file")
    plain = files.where("fingerprint is null").select("file", "rom")
    by_name = plain.join(game.select("game", F.col("game").alias("rom")), "rom").select("game", "file")
    by_set = plain.join(game.select("game", F.col("measured").alias("rom")), "rom").select("game", "file")
    return by_content.unionByName(by_name).unionByName(by_set).distinct()


def fingerprint_of(asked: DataFrame, drivers: DataFrame) -> DataFrame:
    """`asked` (name) with the fingerprint of the first driver of that name in any case; null for none. Drivers: name,
    ord, fingerprint."""
    first = drivers.groupBy(X.ascii_lower(F.col("name")).alias("__n")).agg(F.min(F.struct("ord", "fingerprint")).alias("d"))
    out = asked.withColumn("__n", X.ascii_lower(F.col("name"))).join(first, "__n", "left")
    return out.select(*asked.columns, F.col("d.fingerprint").alias("fingerprint"))


def accepted_files(files: DataFrame) -> DataFrame:
    """`files` (file, fingerprint, rom) with the message that leaves one out, null for those that are taken."""
    message = F.concat("file", F.lit(": names neither a set nor its sounds, left out"))
    return files.withColumn("message", F.when(F.col("fingerprint").isNull() & F.col("rom").isNull(), message))


def first_reason(cases: list[tuple[Column, str]]) -> Column:
    """The reason of the first case that holds; null if none does."""
    return F.coalesce(*[F.when(holds, F.lit(reason)) for holds, reason in cases])


def hints(notes: Column, tests: list[tuple[str, str]]) -> Column:
    """A struct with a boolean for each (name, text): whether the notes hold the text, as it is."""
    return F.struct(*[F.coalesce(F.contains(notes, F.lit(text)), F.lit(False)).alias(name) for name, text in tests])


def marked_playable(entries: DataFrame, labels: DataFrame, reasons: DataFrame) -> DataFrame:
    """`entries` (label) with playable and why, from two levels: a label's reason key, and the reason's state and text.
    Without a key it plays; with one it does not, or only in newer versions. Marking twice gives the same."""
    why = labels.join(reasons, "key", "left").select("label", F.when(F.col("state") == "newer", "newer").otherwise("no").alias("__p"), F.coalesce("text", F.lit("")).alias("__w"))
    out = entries.drop("playable", "why").join(why, "label", "left")
    kept = [c for c in entries.columns if c not in ("playable", "why")]
    return out.select(*kept, F.coalesce("__p", F.lit("yes")).alias("playable"), F.col("__w").alias("why"))


def ordered_union(parts: list[DataFrame], key: str) -> DataFrame:
    """(key, part, ord): the keys of several lists, each once, where it comes first: by list, then by its place in it."""
    every = reduce(DataFrame.unionByName, [p.select(key, F.lit(i).alias("part"), "ord") for i, p in enumerate(parts)])
    return every.groupBy(key).agg(F.min(F.struct("part", "ord")).alias("p")).select(key, "p.part", "p.ord")


def touched(entries: DataFrame, before: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(key): what an edit touches: listed now or before, as far as it is known."""
    return entries.select(key).unionByName(before.select(key)).distinct().join(known.select(key), key, "left_semi")


def selected(commands: DataFrame, only: DataFrame | None, killers: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """(key, ord, place_group): commands in order, or those of `only` (key, ord) in its order, unknown ones included; ones
    that end the session go last. At most `limit` of them, where that is asked for."""
    chosen = commands.select(key, "ord") if only is None else only.select(key, "ord")
    out = chosen.join(killers.select(key).distinct().withColumn("__k", F.lit(1)), key, "left").select(key, "ord", F.coalesce("__k", F.lit(0)).alias("place_group"))
    return out if limit is None else out.orderBy("place_group", "ord", key).limit(limit)


def line_edits(rows: DataFrame) -> DataFrame:
    """(id, base_off, extras): the line edits of each sound. Rows: id, ord, kind (base or extra), state (on or off), fname,
    gain. The last base row decides; gains are whole and within 0 and 100; a sound whose base is on and that has no extra
    is left out."""
    base = F.max(F.when(F.col("kind") == "base", F.struct("ord", (F.col("state") == "off").alias("off"))))
    gain = F.least(F.greatest(F.floor(F.col("gain") + 0.5), F.lit(0)), F.lit(100)).cast("int")
    extra = F.when(F.col("kind") == "extra", F.concat_ws(",", "fname", gain.cast("string"), "state"))
    each = rows.groupBy("id").agg(base.alias("b"), F.array_sort(F.collect_list(F.when(extra.isNotNull(), F.struct("ord", extra.alias("e"))))).alias("x"))
    out = each.select("id", F.coalesce("b.off", F.lit(False)).alias("base_off"), F.transform("x", lambda e: e["e"]).alias("extras"))
    return out.where(F.col("base_off") | (F.size("extras") > 0))
