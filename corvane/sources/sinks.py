"""Sinks: rows as the text lines of packs, dictionaries and reports, written by Spark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators.sequences import profiles


def pack_lines(rows: DataFrame) -> DataFrame:
    """(pack, id, value): the CSV line of each pack row: id, channel (-1 is empty), duck, gain, loop (0 or 100), stop,
    name, file."""
    parts = [
        X.id_text(F.col("id")), F.when(F.col("channel") >= 0, F.col("channel").cast("string")).otherwise(""), F.col("duck").cast("string"), F.col("gain").cast("string"),
        F.when(F.col("loop"), "100").otherwise("0"), F.col("stop").cast("string"), F.concat(F.lit('"'), X.csv_name(F.col("name")), F.lit('"')), F.concat(F.lit('"'), F.col("fname"), F.lit('"')),
    ]
    return rows.select("pack", "id", F.concat_ws(",", *[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))


def dictionary_lines(entries: DataFrame) -> DataFrame:
    """(heading, ord, value): the lines of each section: its heading, then its entries in order."""
    heads = entries.groupBy("heading").agg((F.min("ord") - 1).alias("ord")).select("heading", "ord", F.col("heading").alias("value"))
    return heads.unionByName(entries.select("heading", "ord", F.concat(F.lit(":"), "key", F.lit(":"), F.left("name", F.lit(29))).alias("value")))


def report_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): each row as a JSON object without its null fields."""
    return rows.select(key, F.to_json(F.struct(*rows.columns)).alias("value"))


def merged_settings(existing: DataFrame, generated: DataFrame, forced: list[tuple[str, str]]) -> DataFrame:
    """(section, key, value, ord): settings of both; an existing value stays unless its key is forced; new ones follow
    in their own order."""
    old = existing.select("section", "key", F.col("value").alias("old"), F.col("ord").alias("o"))
    new = generated.select("section", "key", F.col("value").alias("new"), F.col("ord").alias("n"))
    both = old.join(new, ["section", "key"], "full")
    must = F.lit(False)
    for section, key in forced:
        must = must | (F.col("section") == section) & (F.col("key") == key)
    value = F.when(must, F.coalesce("new", "old")).otherwise(F.coalesce("old", "new"))
    return both.select("section", "key", value.alias("value"), F.coalesce("o", F.lit(1_000_000) + F.col("n")).alias("ord"))


def gsound_lines(rows: DataFrame) -> DataFrame:
    """(id, value): the second pack format: its header, under id -1, and the CSV line of each row (id, gtype, duck, fname):
    id, type, gain, ducking profile, file. Music has no profile; another type's depths below 100 are numbered from one, the
    lightest first."""
    ducking = rows.where("gtype != 'MUSIC'")
    numbers = profiles(ducking, "gtype", "duck", 100)
    out = rows.join(numbers, ["gtype", "duck"], "left").withColumn("profile", F.coalesce("profile", F.lit(0)))
    lines = out.select("id", F.concat_ws(",", X.id_text(F.col("id")), "gtype", F.lit("100"), F.col("profile").cast("string"), "fname").alias("value"))
    header = rows.sparkSession.range(1).select(F.lit(-1).cast(dict(rows.dtypes)["id"]).alias("id"), F.lit("ID,TYPE,GAIN,DUCKING_PROFILE,FNAME").alias("value"))
    return header.unionByName(lines)


def replacement_lines(rows: DataFrame, key: str) -> DataFrame:
    """(key, value): the CSV line of each replaced file: id, file, gain, source, level and offset; the source is a plain
    name, figures have two decimals, unknown ones are empty."""
    figure = lambda c: F.coalesce(F.format_string("%.2f", F.col(c)), F.lit(""))
    shown = lambda c: F.when(F.col(c).isNull(), "").otherwise(figure(c))
    parts = [X.id_text(F.col("id")), F.col("fname"), F.col("gain").cast("string"), X.kept_name(F.col("source")), shown("lufs"), shown("offset")]
    return rows.select(key, F.concat_ws(",", *[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))


def _header(like: DataFrame, value: str) -> DataFrame:
    """The one line before all others, under null keys."""
    empty = [F.lit(None).cast(kind).alias(c) for c, kind in like.dtypes if c != "value"]
    return like.sparkSession.range(1).select(*empty, F.lit(value).alias("value")).select(*like.columns)


def line_edit_lines(rows: DataFrame) -> DataFrame:
    """(id, ord, value): the record of line edits: its header, under a null id, then for each sound the line of a base that
    is off, of ord -1, and its further lines in order.

    Rows: id, ord, kind (base or extra), state (on or off), fname, gain, source. The last base row decides; gains are whole
    and within 0 and 100. Sounds without an edit have no line; a record without any has only its header.
    """
    id = X.id_text(F.col("id"))
    last = rows.where("kind = 'base'").groupBy("id").agg(F.max_by("state", "ord").alias("state")).where("state = 'off'")
    off = last.select("id", F.lit(-1).cast(dict(rows.dtypes)["ord"]).alias("ord"), F.concat(id, F.lit(",base,off,,,")).alias("value"))
    gain = F.least(F.greatest(F.floor(F.col("gain") + 0.5), F.lit(0)), F.lit(100)).cast("int").cast("string")
    parts = [id, F.lit("extra"), F.col("state"), F.col("fname"), gain, X.kept_name(F.col("source"))]
    more = rows.where("kind = 'extra'").select("id", "ord", F.concat_ws(",", *[F.coalesce(p, F.lit("")) for p in parts]).alias("value"))
    return _header(off, "ID,KIND,STATE,FNAME,GAIN,SOURCE").unionByName(off).unionByName(more)


def base_lines(bases: DataFrame) -> DataFrame:
    """(file, id, value): the saved base rows (file, id, row) of edited sounds under a header of null keys; the row is always
    quoted. Without a row there is no line at all, not even a header, so no file is written."""
    row = F.concat(F.lit('"'), F.replace("row", F.lit('"'), F.lit('""')), F.lit('"'))
    lines = bases.select("file", "id", F.concat_ws(",", "file", X.id_text(F.col("id")), row).alias("value"))
    some = bases.limit(1).select(F.lit(1).alias("__some"))
    return _header(lines, "FILE,ID,ROW").join(F.broadcast(some), how="left_semi", on=F.lit(True)).unionByName(lines)


def names_lines(packs: DataFrame, sounds: DataFrame, tool: str) -> DataFrame:
    """(pack, place, ord, value): a names file for each pack: its comments of place 0, the header of place 1, and a line for
    each sound with a name, in order.

    Packs: pack, rom, sound_rom_id, version; what is null has no comment. Sounds: pack, ord, id (a text), name. The packs'
    lines are exploded in their rows; sounds are not joined or ordered.
    """
    ord_type = dict(sounds.dtypes)["ord"]
    note = lambda name, c: F.concat(F.lit(f"# {name}: "), F.col(c))
    notes = F.array(F.concat(F.lit(f"# {tool} names")), note("rom", "rom"), note("sound_rom_id", "sound_rom_id"), note(tool, "version"), F.lit("ID,NAME"))
    heads = packs.select("pack", F.posexplode(notes).alias("ord", "value")).where("value is not null")
    heads = heads.select("pack", F.when(F.col("ord") < 4, 0).otherwise(1).alias("place"), F.col("ord").cast(ord_type).alias("ord"), "value")
    named = sounds.where("id is not null and name != ''")
    lines = named.select("pack", F.lit(2).alias("place"), "ord", F.concat_ws(",", X.csv_field(X.normal_id(F.col("id"))), X.csv_field(F.col("name"))).alias("value"))
    return heads.unionByName(lines)


def catalogue_file(entries: DataFrame, key: str, columns: list[str], head: Column) -> DataFrame:
    """(place, key, value): a catalogue as one JSON document of many lines: the head's fields and the opening of the list,
    of place 0; each entry on a line of its own by key, of place 1; the closing line. Keys are distinct.

    Which entry is the last, and has no comma, is the largest key: one row, so nothing is ordered here.
    """
    lines = entry_lines(entries, key, columns)
    last = lines.agg(F.max(key).alias("__last"))
    body = lines.join(F.broadcast(last)).select(F.lit(1).alias("place"), key, F.when(F.col(key) < F.col("__last"), F.concat("value", F.lit(","))).otherwise(F.col("value")).alias("value"))
    text = F.to_json(head)
    # A head without fields is followed by no comma.
    opened = F.concat(F.left(text, F.length(text) - 1), F.when(text == "{}", "").otherwise(","), F.lit('"entries":['))
    one = entries.sparkSession.range(1)
    none = F.lit(None).cast(dict(lines.dtypes)[key]).alias(key)
    return one.select(F.lit(0).alias("place"), none, opened.alias("value")).unionByName(body).unionByName(one.select(F.lit(2).alias("place"), none, F.lit("]}").alias("value")))


def manifests(packs: DataFrame, boards: DataFrame, sounds: DataFrame, rows: DataFrame, twins: DataFrame) -> DataFrame:
    """(pack, value): each pack's nested manifest as one JSON text; fields without a value are left out.

    Packs: pack, rom, parent, factory (whether at the game's own volume), volume. Boards: pack, board, family. Sounds: pack,
    ord, id, name, seconds. Rows: pack, ord, id, file, kind, loop, channel, duck, stop; a sound's last row is shown. Twins:
    pack, id, of, residual_db, lag, lufs_diff; figures have two decimals, the level three. A pack without boards or sounds
    has empty lists. Everything is joined on pack and id; a pack's own list alone meets in a row.
    """
    shown = rows.groupBy("pack", "id").agg(F.max(F.struct("ord", "file", "kind", F.when(F.col("loop"), 100).otherwise(0).alias("loop"), "channel", "duck", F.col("stop").cast("int").alias("stop"))).alias("pack_row"))
    measured = F.struct(X.rounded(F.col("residual_db"), 2).alias("residual_db"), X.rounded(F.col("lag"), 2).alias("lag_samples"), X.rounded(F.col("lufs_diff"), 3).alias("lufs_diff"))
    alike = twins.select("pack", "id", F.col("of").alias("twin_of"), measured.alias("twin"))
    each = sounds.join(shown, ["pack", "id"], "left").join(alike, ["pack", "id"], "left")
    entry = F.struct("id", "name", "seconds", "twin_of", "twin", F.col("pack_row").dropFields("ord").alias("pack"))
    listed = each.groupBy("pack").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id", entry.alias("e")))), lambda s: s["e"]).alias("sounds"))
    of = boards.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("board", "family"))).alias("boards"))
    whole = packs.join(of, "pack", "left").join(listed, "pack", "left")
    nothing = lambda c, df: F.coalesce(F.col(c), F.array().cast(dict(df.dtypes)[c])).alias(c)
    mode = F.when(F.col("factory"), "factory").otherwise("normal").alias("mode")
    volumes = [F.when(F.col("factory"), F.col("volume")).alias("factory_volume"), F.when(~F.col("factory"), F.col("volume")).alias("game_volume")]
    return whole.select("pack", F.to_json(F.struct("rom", "parent", mode, nothing("boards", of), *volumes, nothing("sounds", listed))).alias("value"))


def entry_lines(entries: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, value): each entry as one line of JSON with the columns in order; an entry without a list has an empty one."""
    kinds = dict(entries.dtypes)
    listed = [F.coalesce(F.col(c), F.array().cast(kinds[c])).alias(c) if kinds[c].startswith("array") else F.col(c) for c in columns]
    return entries.select(key, F.to_json(F.struct(*listed)).alias("value"))


def plan_lines(items: DataFrame) -> DataFrame:
    """`items` (plan, name) with the file and the line of each: a file for each plan."""
    return items.withColumns({"file": F.concat("plan", F.lit(".txt")), "value": F.col("name")})


def write_lines(lines: DataFrame, path: str, by: str, order: list[str], line_end: str = "\n") -> None:
    """Text files under `path`, a folder for each `by`, its lines in `order`; written anew each time."""
    lines.repartition(by).sortWithinPartitions(by, *order).select(by, "value").write.mode("overwrite").option("lineSep", line_end).partitionBy(by).text(path)
