"""Packs: rows of sounds, their channels, gains and volumes, and the summaries that are published with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions.exprs import ascii_lower, id_text, rounded


def plain_rows(rows: DataFrame) -> DataFrame:
    """`rows` (kind, looped, continuous) with channel, duck, stop and gtype where nothing more is known: music is on the
    first channel and all else on any; only music that loops is music to a player that loops all of it."""
    gtype = F.when((F.col("kind") == "music") & (F.col("looped") | F.col("continuous")), "MUSIC").when(F.col("kind") == "callout", "CALLOUT").otherwise("SFX")
    return rows.withColumns({"channel": F.when(F.col("kind") == "music", 0).otherwise(-1), "duck": F.lit(100), "stop": F.lit(False), "gtype": gtype})


def chip_rows(rows: DataFrame) -> DataFrame:
    """`rows` as `plain_rows` makes them, changed by what was heard of their chips: chip, ducks_db, stops (null if not
    measured), name. Music that goes on is left alone. A voice goes on its own channel and is a callout, unless it is
    named an effect; it ducks as much as was heard; what stops the music stops it as a voice, else takes its channel."""
    able = F.col("stops").isNotNull() & ~((F.col("kind") == "music") & (F.col("looped") | F.col("continuous")))
    voice, stops = able & (F.col("chip") == "voice"), able & F.coalesce("stops", F.lit(False))
    called = voice & ((F.col("kind") != "sfx") | (F.trim(F.coalesce("name", F.lit(""))) == ""))
    duck = F.least(F.greatest(F.floor(100 * F.pow(F.lit(10.0), F.col("ducks_db") / 20) + 0.5), F.lit(0)), F.lit(100)).cast("int")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumns({
        "gtype": F.when(yes(called), "CALLOUT").otherwise(F.col("gtype")),
        "duck": F.when(able & F.col("ducks_db").isNotNull(), duck).otherwise(F.col("duck")),
        "stop": F.when(yes(stops & voice), True).otherwise(F.col("stop")),
        "channel": F.when(yes(voice), 1).when(yes(stops), 0).otherwise(F.col("channel")),
    })


def pack_totals(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, voices, ducking, stopping, on_music, duck_values): how many rows are on the voice channel, duck, stop, or are
    on the music channel without being music; and the different duck values below 100, the lightest first."""
    values = F.sort_array(F.collect_set(F.when(F.col("duck") < 100, F.col("duck"))), False)
    return rows.groupBy(*by).agg(
        F.count_if(F.col("channel") == 1).alias("voices"), F.count_if(F.col("duck") < 100).alias("ducking"), F.count_if("stop").alias("stopping"),
        F.count_if((F.col("channel") == 0) & (F.col("kind") != "music")).alias("on_music"), values.alias("duck_values"))


def file_gains(files: DataFrame, boards: DataFrame, own: DataFrame, board: str, file: str) -> DataFrame:
    """`files` with gain_db, factor and moved_alone: the gain of each file: its own, else its board's, and 0 on a board
    that was not measured, own gains included. Boards: board, gain_db (null if not measured). Own: file, gain_db."""
    out = files.join(boards.select(board, F.col("gain_db").alias("__b")), board, "left").join(own.select(file, F.col("gain_db").alias("__o"), F.lit(True).alias("__has")), file, "left")
    gain = F.when(F.col("__b").isNotNull(), F.when(F.col("__has"), F.coalesce("__o", F.lit(0.0))).otherwise(F.col("__b"))).otherwise(0.0)
    return out.select(*files.columns, gain.alias("gain_db"), F.pow(F.lit(10.0), gain / 20).alias("factor"), F.coalesce("__has", F.lit(False)).alias("moved_alone"))


def gain_labels(boards: DataFrame, by: str, board: str) -> DataFrame:
    """(by, label): what was done to the volume of each board that was recorded at another than it is written at, or whose
    offset is not known. Boards: by, board, recorded_at, written_at, gain_db."""
    some = boards.where((F.col("recorded_at") != F.col("written_at")) | F.col("gain_db").isNull())
    scaled = F.concat(F.lit("factory "), "written_at", F.lit(" (from reference "), "recorded_at", F.lit(", "), F.format_string("%+.2f", "gain_db"), F.lit(" dB)"))
    text = F.when(F.col("gain_db").isNotNull(), scaled).otherwise(F.concat(F.lit("reference "), "recorded_at", F.lit(" (not scaled)")))
    text = F.concat(F.lit("board "), F.col(board).cast("string"), F.lit(" "), text)
    return some.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(board, text.alias("t")))).alias("x")).select(by, F.array_join(F.transform("x", lambda r: r["t"]), " ").alias("label"))


def volume_notes(boards: DataFrame, commands: DataFrame, by: str, board: str) -> DataFrame:
    """(by, seen, note): whether a master volume was seen, and if not, why, board by board. Boards: by, board, family,
    reason. Commands: by, kind."""
    seen = commands.where("kind = 'master'").select(by).distinct().withColumn("seen", F.lit(True))
    text = F.concat(F.lit("board "), F.col(board).cast("string"), F.lit(" ("), "family", F.lit("): "), F.coalesce("reason", F.lit("no volume command is known")))
    notes = boards.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(board, text.alias("t")))).alias("x"))
    seen_or = F.coalesce("seen", F.lit(False))
    return notes.join(seen, by, "left").select(by, seen_or.alias("seen"), F.when(~seen_or, F.array_join(F.transform("x", lambda r: r["t"]), "; ")).alias("note"))


def counted(with_loops: bool) -> Column:
    """Whether a row counts in loudness totals: written, measured, following the volume, and no loop unless asked for."""
    kept = F.col("file").isNotNull() & F.col("lufs").isNotNull() & ~F.col("ignores_volume")
    return kept if with_loops else kept & ~F.col("loops")


#: The factor of a level for each unit that a program lowers it by, and the types of programs that play and that wait.
UNIT_FACTOR, PLAYS, WAITS = 0.9733, 1, 2


def duck_units(ducks: str, channel: int) -> Column:
    """The units of the first duck of a channel in an array of (channel, units); null for none."""
    return F.get(F.filter(ducks, lambda d: d["channel"] == channel), F.lit(0))["units"]


def duck_percent(units: Column) -> Column:
    """What a level change of `units` leaves of a level, in percent; 100 where nothing is lowered or known."""
    percent = F.floor(100 * F.pow(F.lit(UNIT_FACTOR), -F.least(units, F.lit(0.0))) + 0.5)
    return F.coalesce(F.least(F.greatest(percent, F.lit(0)), F.lit(100)), F.lit(100)).cast("int")


def program_rows(rows: DataFrame, programs: DataFrame, voices: DataFrame, pack: str) -> DataFrame:
    """`rows` as `plain_rows` makes them, changed by what their programs do, with lost_stop. Rows: pack, id. Programs:
    pack, id, type, channel, streams (the channels it plays on), ducks (channel, units), stops (channels), error (null where
    it was read); one for an id at most. Voices: pack, voice, the elected channel.

    Rows whose program is not known or was not read stay. One that plays a stream on its home channel 0 is music, on the
    first channel, undamped; only music that goes on is music to a player that loops all of it. Others are callouts on the
    second channel if their home is the elected one, else effects on any. They duck the music as much as their program
    does, and those on the voice channel stop it if theirs does; another that does has a lost stop.
    """
    read = programs.where("error is null").select(pack, "id", F.struct("type", "channel", "streams", "ducks", "stops").alias("__p"))
    out = rows.join(read, [pack, "id"], "left").join(voices.select(pack, F.col("voice").alias("__voice")), pack, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    known = F.col("__p").isNotNull()
    music = yes((F.col("__p.type") == PLAYS) & (F.col("__p.channel") == 0) & F.array_contains("__p.streams", 0))
    voice = known & ~music & yes(F.col("__p.channel") == F.col("__voice"))
    stopping = known & ~music & yes(F.array_contains("__p.stops", 0))
    new = {
        "channel": F.when(music, 0).when(voice, 1).when(known, -1).otherwise(F.col("channel")),
        "duck": F.when(music, 100).when(known, duck_percent(duck_units("__p.ducks", 0))).otherwise(F.col("duck")),
        "gtype": F.when(music, F.when(F.col("looped") | F.col("continuous"), "MUSIC").otherwise("SFX")).when(voice, "CALLOUT").when(known, "SFX").otherwise(F.col("gtype")),
        "stop": F.when(known, voice & stopping).otherwise(F.col("stop")) if "stop" in rows.columns else voice & stopping,
        "lost_stop": stopping & ~voice,
    }
    new["stop"] = F.when(music, F.col("stop")).otherwise(new["stop"])
    return out.withColumns(new).drop("__p", "__voice")


def pack_limits(rows: DataFrame, pack: str) -> DataFrame:
    """(pack, lost): the ids, in order, of rows with a lost stop as one text; only packs that have any."""
    lost = rows.where("lost_stop").groupBy(pack).agg(F.sort_array(F.collect_set("id")).alias("ids"))
    return lost.select(pack, F.array_join(F.transform("ids", id_text), " ").alias("lost"))


def channel_summary(programs: DataFrame, by: str) -> DataFrame:
    """(by, channel, tracks, with_stream, ducking): of each channel how many programs that play have it as their home, how
    many of those have a stream, and how many lower the music. Programs: as of `program_rows`."""
    lowers = F.coalesce(duck_units("ducks", 0) < 0, F.lit(False))
    return programs.where(F.col("type") == PLAYS).groupBy(by, "channel").agg(F.count("*").alias("tracks"), F.count_if(F.size("streams") > 0).alias("with_stream"), F.count_if(lowers).alias("ducking"))


def program_lists(programs: DataFrame, by: str, stop_id: int) -> DataFrame:
    """(by, id, list, channels, note): what has to be said of single programs, a row for each list that one is on: those
    that only stop (their stops, and whether the player does it: it knows `stop_id` alone), those that wait (their home),
    and those that could not be read."""
    stops = F.col("list") == "stop"
    only = (F.size("streams") == 0) & (F.size("stops") > 0)
    lists = F.array_compact(F.array(F.when(only, F.lit("stop")), F.when(F.col("type") == WAITS, F.lit("deferred")), F.when(F.col("error").isNotNull(), F.lit("unreadable"))))
    found = programs.select(by, "id", "channel", "stops", F.explode(lists).alias("list"))
    note = F.when(stops & (F.col("id") == stop_id), "built in").when(stops & F.array_contains("stops", 0), "lost: only one id stops the music").when(stops, "lost: a voice or an effect cannot be stopped")
    channels = F.when(stops, F.col("stops")).when(F.col("list") == "deferred", F.array("channel"))
    return found.select(by, "id", "list", channels.alias("channels"), note.alias("note"))


def song_roles(samples: DataFrame, song: str) -> DataFrame:
    """(song, roles): a map from each role of a song to its sample; of several the last one stands."""
    last = samples.groupBy(song, "role").agg(F.max(F.struct("ord", "sample")).alias("s"))
    return last.groupBy(song).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", F.col("s.sample").alias("sample"))))).alias("roles"))


def boards_of(machines: DataFrame, table: DataFrame, default: str) -> DataFrame:
    """`machines` (init, generation) with boards: by both, else by the initialiser alone, else `default`; two boards are
    joined by a plus. Table: init, generation (null for any), place, board."""
    named = table.groupBy("init", "generation").agg(F.array_sort(F.collect_list(F.struct("place", "board"))).alias("x"))
    named = named.select("init", "generation", F.array_join(F.transform("x", lambda r: r["board"]), "+").alias("__b"))
    exact = named.where("generation is not null").withColumnRenamed("__b", "__exact")
    loose = named.where("generation is null").select("init", F.col("__b").alias("__loose"))
    out = machines.join(exact, ["init", "generation"], "left").join(loose, "init", "left")
    return out.select(*machines.columns, F.coalesce("__exact", "__loose", F.lit(default)).alias("boards"))


def merged_files(files: DataFrame) -> DataFrame:
    """(set, name, crc, region, sound): a set's files, one that is loaded into several regions once: by name in any case
    and content; its regions joined by plus in order, and whether any of them is a sound region."""
    one = files.groupBy("set", ascii_lower(F.col("name")).alias("name"), "crc").agg(F.array_sort(F.collect_set("region")).alias("r"), F.bool_or("sound").alias("sound"))
    return one.select("set", "name", "crc", F.array_join("r", "+").alias("region"), "sound")


def whole_cycles(period: Column, most: int, within: float) -> Column:
    """The least number of periods, up to `most`, whose length is a whole number but for `within`; null for none."""
    near = F.filter(F.sequence(F.lit(1), F.lit(most)), lambda n: F.abs(n * period - F.floor(n * period + 0.5)) <= within)
    return F.when(F.size(near) > 0, F.get(near, F.lit(0)))


def search_cap(intro: Column, period: Column, least: float = 20.0, most: float = 60.0, spare: float = 2.0, longest: float = 900.0) -> Column:
    """struct(need, ready, usable): how long a loop of a known period has to be heard, when that is reached, and whether
    within the longest recording."""
    need = F.least(F.greatest(period, F.lit(least)), F.lit(most))
    ready = intro + period + need + spare
    return F.struct(need.alias("need"), ready.alias("ready"), (ready <= longest).alias("usable"))


def recorded_until(base: Column, plan: Column, period: Column, check: float = 5.0) -> Column:
    """struct(cap, hint, reason): the seconds a sound is recorded at most, the period to look for, and why there is none.
    `plan` is the `search_cap` of the period, null where no loop is known: a loop that can be confirmed in time
    lengthens the recording to one check after that."""
    usable = F.coalesce(plan["usable"], F.lit(False))
    reason = F.when(plan.isNotNull() & ~usable, "too long to confirm")
    return F.struct(F.when(usable, F.greatest(base, plan["ready"] + check)).otherwise(base).alias("cap"), F.when(usable, period).alias("hint"), reason.alias("reason"))


def unresolved_reason(seconds: Column, note: Column, program: Column, repeats: Column, length: Column, reason: Column, confirm: float = 20.0) -> Column:
    """Why a sound that went on to its cap has no loop, from what is known of it; parts that are not known are left out. A
    program that loops may have a period, which the audio then did not confirm, and a reason of its own beside it."""
    figure = lambda x: F.format_string("%.3f", x)
    loops = F.coalesce(program == "loops", F.lit(False))
    told = F.when(loops & repeats.isNotNull(), F.concat(F.lit("the program repeats every "), figure(repeats), F.lit(" s, which the audio did not confirm")))
    told = told.when(program == "ends", F.concat(F.lit("the program ends after "), figure(F.coalesce(length, F.lit(0.0))), F.lit(" s"))).when(program.isNotNull(), F.concat(F.lit("program: "), reason))
    parts = F.array(
        F.concat(F.lit("no exact repetition within "), F.format_string("%.0f", F.rint(seconds)), F.lit(f" s (the period must hold over two cycles and at least {confirm:.0f} s)")),
        note,
        told,
    )
    return F.concat(F.array_join(F.array_compact(parts), "; "), F.when(loops & reason.isNotNull(), F.concat(F.lit(" ("), reason, F.lit(")"))).otherwise(""))


def human_bytes(n: Column) -> Column:
    """A size as pages show it: whole bytes, tenths of KiB or hundredths of MiB, without decimals where it is whole."""
    def shown(unit: int, name: str, digits: int) -> Column:
        part = F.when(n % unit == 0, F.format_string("%d", F.floor(n / unit))).otherwise(F.format_string(f"%.{digits}f", rounded(n / unit, digits)))
        return F.concat(part, F.lit(name))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, shown(1 << 10, " KiB", 1)).otherwise(shown(1 << 20, " MiB", 2))


def grouped_digits(n: Column, between: str = ",") -> Column:
    """A whole number with its digits in groups of three."""
    return F.replace(F.format_number(n, 0), F.lit(","), F.lit(between))


def byte_list(text: Column, strict: bool = False) -> Column:
    """The bytes of a hex text with or without 0x as an upper-case text; an odd digit gets a zero in front, or makes a
    `strict` one null, as does anything that is no hex."""
    digits = F.regexp_extract(text, r"^(?:0[xX])?([0-9A-Fa-f]+)$", 1)
    odd = F.length(digits) % 2 == 1
    padded = F.when(odd, F.concat(F.lit("0"), digits)).otherwise(digits)
    return F.when((digits != "") & ~(odd & F.lit(strict)), F.upper(padded))


def banked(bank: Column, pointer: Column, size: int = 0x4000) -> Column:
    """The place in a file of a pointer into the window that shows one bank; null if it points elsewhere."""
    return F.when(pointer.between(size, 2 * size - 1), bank * size + pointer - size)


def pointer24(high: Column, middle: Column, low: Column) -> Column:
    """A 24-bit pointer of three bytes, the highest first."""
    return (high * 65536 + middle * 256 + low).cast("long")
