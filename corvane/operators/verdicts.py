"""Verdicts: what a unit is, what a set's figures are worth, and which runs count. Joins and partial aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.exprs import ascii_lower

#: Set states in which all needed files are there.
COMPLETE = ["good", "split"]


def listed(order: list[str | Column], text: Column, where: Column) -> Column:
    """The texts of the rows of a group for which `where` holds, in order, joined by commas."""
    rows = F.array_sort(F.collect_list(F.when(where, F.struct(*order, text.alias("t")))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), ", ")


def unit_verdicts(units: DataFrame, sets: DataFrame, extras: DataFrame) -> DataFrame:
    """(unit, status, issues): the verdict on each unit, and what is wrong with it in a fixed order.

    Units: unit, stem, support (whether it holds a known support file). Sets, those it matches: unit, ord, set, parent,
    system, status (good, split, bad-dump, incomplete), unverified (names of its files that nobody dumped, or null),
    folders (those its files are in, the top one being empty, or null), renamed (files under another name, or null). Extras:
    unit, member, kind, other (a set that has it, or null). A unit of no set is support or unknown; one of complete sets is
    split, misnamed or ok; else it is a bad dump or incomplete. What is to be said of a set stands together, set after set.
    The sets and extras of a unit are as many as an archive has.
    """
    within = F.filter("folders", lambda f: f != "")
    notes = F.array_compact(F.array(
        F.concat(F.lit("not verifiable: "), "unverified"),
        F.when(F.size(within) > 0, F.concat(F.lit("subfolder: "), "set", F.lit(" is in "), F.array_join(within, "/, "), F.lit("/"))),
        F.concat(F.lit("files under another name: "), "renamed")))
    sets = sets.withColumn("notes", notes)
    named = ascii_lower(F.col("set")) == ascii_lower(F.col("stem"))
    done = F.col("status").isin(COMPLETE)
    found = sets.join(units.select("unit", "stem"), "unit").groupBy("unit").agg(
        F.count("*").alias("n"),
        F.bool_or(named).alias("named"),
        F.bool_and(F.col("system") & (F.col("status") == "good")).alias("all_system"),
        F.bool_or(done).alias("complete"),
        F.bool_or(F.col("status") == "split").alias("split"),
        F.bool_and(F.col("status") == "bad-dump").alias("bad"),
        F.min(F.coalesce("parent", "set")).alias("family"),
        F.max(F.coalesce("parent", "set")).alias("family_to"),
        F.min(F.struct("ord", "set"))["set"].alias("first"),
        listed(["ord", "set"], F.col("set"), F.lit(True)).alias("sets"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "set", "notes"))), lambda r: r["notes"])).alias("notes"),
    )
    other = F.concat("member", F.lit(" ("), F.coalesce("other", "kind"), F.lit(")"))
    more = extras.groupBy("unit").agg(
        listed(["member"], F.col("member"), F.col("kind") == "not-a-rom").alias("no_content"),
        listed(["member"], F.col("member"), F.col("kind") == "unknown").alias("unknown"),
        listed(["member"], other, F.col("kind").isin("rom-of-other-set", "duplicate")).alias("others"),
    )
    out = units.join(found, "unit", "left").join(more, "unit", "left")
    of_family = (F.col("family") == F.col("family_to")) & (F.col("family") == F.col("stem"))
    misnamed = ~F.col("named") & ((F.col("n") == 1) | ~of_family)
    misnamed_text = F.concat(F.lit("misnamed: named "), "stem", F.lit(", holds "), "first")
    note = lambda c, lead: F.when(F.col(c) != "", F.concat(F.lit(lead), F.col(c)))
    merged = F.when(F.col("n") > 1, F.concat(F.lit("merged: holds "), F.col("n").cast("string"), F.lit(" sets ("), "sets", F.lit(")")))
    after = F.array(note("no_content", "no content: "), note("unknown", "unknown files: "), note("others", "extra files: "))
    issues = F.concat(F.array_compact(F.array(merged, F.when(misnamed, misnamed_text))), F.col("notes"), F.array_compact(after))
    system = F.array(F.concat(F.lit("system files: "), "first"), F.when(~F.col("named"), misnamed_text))
    none = F.array(F.when(F.col("support"), "support file, no set").otherwise("no file of any set"))
    of = F.when(F.col("split"), "split").when(misnamed, "misnamed").otherwise("ok")
    status = F.when(F.col("n").isNull(), F.when(F.col("support"), "support").otherwise("unknown")).when(F.col("all_system"), "support")
    status = status.when(F.col("complete"), of).when(F.col("bad"), "bad-dump").otherwise("incomplete")
    issues = F.when(F.col("n").isNull(), none).when(F.col("all_system"), F.array_compact(system)).otherwise(issues)
    return out.select("unit", status.alias("status"), issues.alias("issues"))


def best_sets(units: DataFrame, sets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(unit, set, extractable): the set a unit is about, the one of its name or else the first, and whether it can be
    worked on: a complete set under its own name."""
    named = ascii_lower(F.col("set")) == ascii_lower(F.col("stem"))
    rows = sets.join(units.select("unit", "stem"), "unit").select("unit", F.struct((~named).alias("unnamed"), "ord", "set", "status").alias("s"))
    best = rows.groupBy("unit").agg(F.min("s").alias("s")).join(verdicts.select("unit", F.col("status").alias("verdict")), "unit")
    able = F.col("verdict").isin("ok", "split") & F.col("s.status").isin(COMPLETE) & ~F.col("s.unnamed")
    return best.select("unit", "s.set", able.alias("extractable"))


def verified_groups(sets: DataFrame, fingerprint: str) -> DataFrame:
    """(fingerprint, place, set): the different verified sets of each content, system sets aside, as they were first seen."""
    seen = sets.where(F.col(fingerprint).isNotNull() & (F.col("status") == "good") & ~F.col("system"))
    first = seen.groupBy(fingerprint, "set").agg(F.min("ord").alias("ord"))
    place = F.row_number().over(W.partitionBy(fingerprint).orderBy("ord", "set"))
    return first.select(fingerprint, place.alias("place"), "set")


def not_applicable(sets: DataFrame, by_set: DataFrame, by_family: DataFrame, entry: str) -> DataFrame:
    """(entry, reason): why there is nothing to do for an entry: its family's reason, else the first set's, if all of its
    sets have one. Sets: entry, ord, set, family, sounds, undumped (how many sounds nobody dumped), audio. By set: set,
    reason; by family: family, reason. A set of its own reason keeps it; one without a sound although it has the hardware
    for it, and one whose sounds were all never dumped, have theirs."""
    own = sets.join(by_set.select("set", F.col("reason").alias("of_set")), "set", "left")
    rule = F.when((F.col("sounds") == 0) & F.col("audio"), "no sound is listed").when((F.col("sounds") > 0) & (F.col("sounds") == F.col("undumped")), "never dumped")
    why = own.withColumn("why", F.coalesce("of_set", rule))
    each = why.groupBy(entry).agg(F.min(F.struct("ord", "family", "why")).alias("head"), F.bool_and(F.col("why").isNotNull()).alias("all"))
    each = each.select(entry, F.col("head.family").alias("family"), F.when(F.col("all"), F.col("head.why")).alias("why"))
    return each.join(by_family.select("family", F.col("reason").alias("of_family")), "family", "left").select(entry, F.coalesce("of_family", "why").alias("reason"))


def enriched(sets: DataFrame, families: DataFrame, support: DataFrame, found: DataFrame) -> DataFrame:
    """`sets` (set, code) with its family, the family's support, and whether it was found; unknown, untested and absent
    where a table says nothing. Families: code, family; support: family, support; found: set."""
    out = sets.join(families.select("code", "family"), "code", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    out = out.join(support.select("family", "support"), "family", "left")
    out = out.join(found.select("set").distinct().withColumn("__found", F.lit(True)), "set", "left")
    return out.select(*sets.columns, "family", F.coalesce("support", F.lit("untested")).alias("support"), F.coalesce("__found", F.lit(False)).alias("found"))


def measured_sets(sets: DataFrame, runs: DataFrame, entry: str) -> DataFrame:
    """(entry, set, role, figure, caveat): the measured set of each entry, a set with a full run, of those without parent
    first; and each other set whose volume is known and differs from that one's, with its own figure, or why it has none.

    Sets: entry, ord, set, parent. Runs: set, figure (null without a full run), volume, boot_volume (from the two kinds of
    report, the first before the second). Sets of equal volume have the measured set's figure and no row.
    """
    seen = sets.join(runs, "set").withColumn("volume", F.coalesce("volume", "boot_volume"))
    first = F.min(F.when(F.col("figure").isNotNull(), F.struct(F.col("parent").isNotNull().alias("clone"), "ord", "set", "figure", "volume")))
    base = seen.groupBy(entry).agg(first.alias("b")).where("b is not null")
    rest = seen.join(base, entry).where((F.col("set") != F.col("b.set")) & F.col("volume").isNotNull() & ~F.col("volume").eqNullSafe(F.col("b.volume")))
    text = F.concat(F.lit("its volume differs from "), F.col("b.set").cast("string"), F.lit("'s and it was not measured"))
    rest = rest.select(entry, "set", F.lit("differs").alias("role"), "figure", F.when(F.col("figure").isNull(), text).alias("caveat"))
    return base.select(entry, F.col("b.set").alias("set"), F.lit("measured").alias("role"), F.col("b.figure").alias("figure"), F.lit(None).cast("string").alias("caveat")).unionByName(rest)


def loudness_slots(rows: DataFrame, level: str) -> DataFrame:
    """`rows` with main, static, at_reference and caveat: where a level belongs. A decoded one is static; one that could
    not be scaled, or whose volume is stepped and was left where it stood at power-on, is at the reference volume; the main
    figure is null then, so that nobody takes them for one.

    Rows: decoded, complete, volume_mode, dead_from (a dead board's first silent id, or null), borrowed, unscaled, stepped.
    The offset's caveat is left out where the steps' says more.
    """
    scaled_late, stepped = F.col("unscaled") & ~F.col("decoded"), F.coalesce("stepped", F.lit(False))
    caveats = F.array(
        F.when(F.col("decoded"), "decoded, not measured in a game"),
        F.when(~F.col("complete"), "a partial run"),
        F.when((F.col("volume_mode") != "factory") & ~F.col("decoded"), F.concat(F.lit("not at the factory volume (volume_mode "), "volume_mode", F.lit(")"))),
        F.when(F.col("dead_from").isNotNull(), F.concat(F.lit("incomplete: silent from "), F.col("dead_from").cast("string"), F.lit(" on"))),
        F.when(F.col("borrowed"), "approximate: another set's sounds"),
        F.when(stepped, "not at the game's level: the step volume stands where it was at power-on"),
        F.when(scaled_late & ~stepped, "the factory offset could not be measured"),
    )
    text, kept_apart = F.array_join(F.array_compact(caveats), "; "), (scaled_late | stepped) & ~F.col("decoded")
    return rows.select(
        *rows.columns,
        F.when(~F.col("decoded") & ~kept_apart, F.col(level)).alias("main"),
        F.when(F.col("decoded"), F.col(level)).alias("static"),
        F.when(kept_apart, F.col(level)).alias("at_reference"),
        F.when(text != "", text).alias("caveat"),
    )


def recorded_volumes(recorded: DataFrame, by: str) -> DataFrame:
    """(by, texts): at which volume each board was recorded and where that is known from, in their order. Recorded: by,
    ord, board, family, volume, origin; a row without any of them says nothing."""
    text = F.concat(F.lit("board "), F.col("board").cast("string"), F.lit(" ("), "family", F.lit("): "), "volume", F.lit(": "), "origin")
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("ord", text.alias("t")))))
    return recorded.groupBy(by).agg(F.transform(rows, lambda r: r["t"]).alias("texts"))


def is_current(measurement: Column, current: str) -> Column:
    """Whether a measurement, a JSON object, has the settings of `current`, the version aside; false for null."""
    bare = lambda text: F.array_sort(F.map_entries(F.map_filter(F.from_json(text, "map<string,string>"), lambda k, v: k != "version")))
    return F.coalesce(bare(measurement) == bare(F.lit(current)), F.lit(False))


def is_done(measurement: Column, current: str, boot_only: bool, reason: Column, written: Column) -> Column:
    """Whether a run need not be repeated: measured the same way, version included, and of use: it wrote something, or
    there is nothing to write, or only the boot is asked for."""
    whole = lambda text: F.array_sort(F.map_entries(F.from_json(text, "map<string,string>")))
    return F.coalesce(whole(measurement) == whole(F.lit(current)), F.lit(False)) & (F.lit(boot_only) | reason.isNotNull() | F.coalesce(written > 0, F.lit(False)))


def recap(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """(by, ok, failed, not_applicable, written, exit_code): how jobs ended. Outcomes: by, error, reason, written. A job
    with an error failed, whatever else it has; one with a reason was not applicable; only failures set the exit code."""
    status = F.when(F.col("error").isNotNull(), "failed").when(F.col("reason").isNotNull(), "not_applicable").otherwise("ok")
    seen = outcomes.withColumn("status", status)
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    wrote = F.coalesce(F.sum(F.when(F.col("status") == "ok", F.coalesce("written", F.lit(0)))), F.lit(0)).cast("long")
    return seen.groupBy(*by).agg(count("ok"), count("failed"), count("not_applicable"), wrote.alias("written"), F.max((F.col("status") == "failed").cast("int")).alias("exit_code"))
