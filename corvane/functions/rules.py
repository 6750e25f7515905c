"""Rules that classify one row: kinds, names, flags, labels, volume commands, tests. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.exprs import ascii_lower, rounded

# Extensions of files that belong to no set.
NO_CONTENT = ["vpx", "vpt", "directb2s", "txt", "nfo", "diz", "ini", "cfg", "nv", "pdf", "jpg", "jpeg", "png", "gif", "bmp", "wav", "mp3", "ogg", "exe", "dll", "url", "htm", "html", "md", "csv", "zip", "7z", "rar", "db"]


def marked_kind(name: Column) -> Column:
    """The kind that a name says out loud by its marker or its quotes; null if it says none."""
    bare = F.regexp_replace(name, r"^\s+", "")
    low = ascii_lower(bare)
    spoken = bare.startswith('"') | low.startswith("vox:") | low.startswith("voice:")
    return F.when(low.startswith("music:"), "music").when(spoken, "callout").when(low.startswith("sfx:"), "sfx")


def kind(name: Column, playing: Column, heard: Column) -> Column:
    """What keeps playing is music; else the name decides, then what was heard; the rest is an effect."""
    return F.when(playing, F.lit("music")).otherwise(F.coalesce(marked_kind(name), heard, F.lit("sfx")))


def file_kind(loops: Column, extended: Column) -> Column:
    return F.when(loops & extended, "intro-loop-extended").when(loops, "body-loop").otherwise("one-shot")


def shown_length(seconds: Column, ended_by: Column) -> Column:
    """A length as names show it: tenths below ten seconds, ties to the even digit."""
    whole = F.format_string("%.0f", F.rint(seconds))
    tenths = F.format_string("%.1f s", F.rint(seconds * 10) / 10)
    return F.when(ended_by == "loop", "loop").when(ended_by == "max", F.concat(whole, F.lit("+ s"))).when(seconds < 10, tenths).otherwise(F.concat(whole, F.lit(" s")))


def generated_name(sound: Column, seconds: Column, ended_by: Column, heard: Column) -> Column:
    """The name of a sound that nobody named; a tilde marks what was only heard."""
    digits = F.upper(F.regexp_replace(sound, "^(0x)*(0X)*", ""))
    guess = F.when(heard != "", F.concat(F.lit(" ~"), heard))
    return F.concat(F.lit("Sound "), digits, F.coalesce(guess, F.lit("")), F.lit(" ("), shown_length(seconds, ended_by), F.lit(")"))


def flags(cases: list[tuple[str, Column]]) -> Column:
    """The labels whose conditions hold, in the order given."""
    return F.array_compact(F.array(*[F.when(holds, F.lit(label)) for label, holds in cases]))


def volume_command(family: Column, recent: Column) -> Column:
    """struct(kind, value, level, level_max): the volume command that the last bytes of a board's stream are, else null.

    `recent` is an array of bytes, oldest first. A checked byte is followed by its complement.
    """
    b = lambda k: F.try_element_at(recent, F.lit(-k))
    eighths = F.when(b(1) == 255, 31).otherwise(F.floor(b(1) / 8)).cast("int")
    checked = b(1) + b(2) == 255

    def found(kind: Column, value: Column, level: Column, most: int) -> Column:
        return F.struct(kind.alias("kind"), value.cast("int").alias("value"), level.cast("int").alias("level"), F.lit(most).alias("level_max"))

    hexed = lambda prefix, k: F.concat(F.lit(prefix), F.lpad(F.hex(b(k).cast("long")), 2, "0"))
    master, lead = F.lit("master"), b(4) == 0x55
    p2k = F.when(b(2) + b(1) == 255, F.when(b(2) == 255, 31).otherwise(F.floor(b(2) / 8)))
    return (
        F.when((family == "DCS") & lead & checked & (b(3) == 0xAA), found(master, b(2), F.floor(F.greatest(b(2) - 7, F.lit(0)) / 8), 31))
        .when((family == "DCS") & lead & checked & b(3).between(0xAB, 0xB0), found(hexed("channel ", 3), b(2), b(2), 255))
        .when((family == "DCSP2K") & lead & checked & (b(3) == 0xAA), found(master, b(2), p2k, 31))
        .when((family == "DCSP2K") & lead & (b(3) == 0xAB) & (b(2) < 64), found(hexed("channel volume ", 2), b(1), eighths, 31))
        .when((family == "DCSP2K") & lead & (b(3) == 0xAC) & (b(2) < 64), found(hexed("channel pan ", 2), b(1), b(1), 255))
        .when((family == "WPCS") & (b(3) == 0x79) & checked, found(master, b(2), b(2), 31))
        .when(family.isin("BSMT", "AT91") & (b(2) == 0xFE) & b(1).between(0x10, 0x2F), found(master, b(1), 0x2F - b(1), 31))
    )


def family_label(board: Column, own_board: Column) -> Column:
    """Board names without their prefix, joined by plus; `own_board`: a machine whose sound is not on a board."""
    none = F.when(own_board, "NONE (Stern SAM)").otherwise("NONE (other)")
    parts = F.transform(F.split(board, r"\+"), lambda p: F.regexp_replace(p, "^SNDBRD_", ""))
    return F.when(board.isNull(), "unknown").when(board == "SNDBRD_NONE", none).otherwise(F.array_join(parts, "+"))


def game_version(name: Column) -> Column:
    """struct(game, version) of a set name of the two games whose names carry one; null for other names."""
    part = lambda k: F.regexp_extract(name, r"^(rfm|swep1)_([0-9]+)", k)
    return F.when(part(1) != "", F.struct(part(1).alias("game"), part(2).alias("version")))


def extra_kind(used_elsewhere: Column, of_other_set: Column, name: Column) -> Column:
    """What a member that no set needed is: a copy of one that is used, one of another set, no content, or unknown."""
    extension = ascii_lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return F.when(used_elsewhere, "duplicate").when(of_other_set, "rom-of-other-set").when(extension.isin(NO_CONTENT), "not-a-rom").otherwise("unknown")


def ignores_volume(moved: Column, reference: Column, least: float = 3.0) -> Column:
    """Whether a level did not follow as the reference did: off by over half of its step and over `least`; without a
    reference, by less than `least` at all."""
    follows = F.abs(moved - reference) > F.greatest(F.abs(reference) / 2, F.lit(least))
    return F.coalesce(F.when(reference.isNotNull(), follows).otherwise(F.abs(moved) < least), F.lit(False))


def confidence(residual_db: Column) -> Column:
    return rounded(1 - F.pow(F.lit(10.0), residual_db / 20), 3)


def edit_offset(lufs: Column, gain: Column, level: Column) -> Column:
    """By how much a replaced sound is louder than the original, in dB; null without a gain or a level."""
    return F.when(gain > 0, lufs + 20 * F.log10(gain / 100) - level)


# Boards without a volume stage, or with one that is not emulated, and why a family reports no volume.
NO_STAGE, NOT_EMULATED = "full_scale (no volume stage)", "full_scale (volume lines not emulated in PinMAME)"
FULL_SCALE = {"BY45": NO_STAGE, "BYTCS": NO_STAGE, "BSMT (Data East)": NO_STAGE, "BY32": NO_STAGE, "BY51": NO_STAGE, "BY56": NO_STAGE, "BY51N": NO_STAGE, "BYSNT": NOT_EMULATED}
SILENT_ON_VOLUME = {
    "DCS": "the game sent no 55 AA vv ~vv during boot (the board keeps its reset default, 67)",
    "DCSP2K": "the game sent no 55AA vv ~vv during boot",
    "WPCS": "the game sent no 79 vv ~vv during boot",
    "BSMT": "no FE 10..2F seen (Whitestar's master volume command)",
    "AT91": "no FE 10..2F seen (Whitestar's master volume command)",
    "BSMT (Data East)": "Data East sets the master volume with a hardware pot",
    "BY45": "Cheap Squeak boards have no volume stage",
    "BYTCS": "Cheap Squeak boards have no volume stage",
    "BY32": "the early Bally sound boards have no volume stage",
    "BY51": "the early Bally sound boards have no volume stage",
    "BY56": "the early Bally sound boards have no volume stage",
    "BY51N": "the early Bally sound boards have no volume stage",
    "BYSNT": "the Squawk & Talk's volume lines are not emulated in PinMAME (its commands DF..FE)",
}
SYSTEM_11, SYSTEM_11_SILENT = "WMSS11", "System 11 sound boards have no volume stage"
UNKNOWN_SILENT = "no known volume command for this board family"


def _by_family(family: Column, texts: dict[str, str], system_11: str, otherwise: Column) -> Column:
    named = F.create_map(*[F.lit(x) for pair in texts.items() for x in pair])
    return F.when(F.startswith(family, F.lit(SYSTEM_11)), system_11).otherwise(F.coalesce(F.try_element_at(named, family), otherwise))


def full_scale(family: Column) -> Column:
    """What a board without a volume that could be set plays at; null for a family that has one, or a null one."""
    return _by_family(family, FULL_SCALE, NO_STAGE, F.lit(None).cast("string"))


def no_volume_reason(family: Column) -> Column:
    """Why a board of a family reported no volume."""
    return _by_family(family, SILENT_ON_VOLUME, SYSTEM_11_SILENT, F.lit(UNKNOWN_SILENT))
