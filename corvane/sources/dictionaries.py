"""Sectioned dictionaries as their exact reader reads them, and the text that it reads whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a piece of a line, bytes of a line that is read whole, and characters of a name.
PIECE, LINE, NAME = 100, 98, 29


def pieces(line: Column, piece: int = PIECE) -> Column:
    """A line as its reader's buffer gets it: while `piece` bytes or more are left, as many whole characters as fit are a
    line of their own. So a line of just `piece` bytes is followed by an empty one."""
    none = F.array().cast("array<string>")

    def take(s: Column, c: Column) -> Column:
        full = F.octet_length(s["now"]) + F.octet_length(c) > piece
        return F.struct(F.when(full, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.when(full, c).otherwise(F.concat(s["now"], c)).alias("now"))

    def end(s: Column) -> Column:
        out = F.array_append(s["done"], s["now"])
        return F.when(F.octet_length(s["now"]) >= piece, F.array_append(out, F.lit(""))).otherwise(out)

    whole = F.aggregate(F.split(line, ""), F.struct(none.alias("done"), F.lit("").alias("now")), take, end)
    return F.when(F.octet_length(line) < piece, F.array(line)).otherwise(whole)


def buffered_lines(texts: DataFrame, piece: int = PIECE) -> DataFrame:
    """(path, line, value): the lines of each text (path, text) by number from zero, as `pieces`. An empty line is a line;
    the end of the last one begins none; carriage returns at the ends go."""
    body = F.regexp_replace("text", r"\n\z", "")
    split = texts.where("text is not null").select("path", F.transform(F.split(body, "\n"), lambda v: F.regexp_replace(v, r"\r\z", "")).alias("v"))
    return split.select("path", F.posexplode(F.flatten(F.transform("v", lambda v: pieces(v, piece)))).alias("line", "value"))


def exact_entries(lines: DataFrame) -> DataFrame:
    """(path, section, heading, line, key, name): the entries of lines (path, line, value) under each heading.

    A heading is any line that begins with none of `:;#` and a blank, an empty one too, which so ends a section. An entry
    is a colon, lower-case hex digits, one character of any kind and the name: an odd digit is dropped, other digits end
    the key, and names are cut. `section` is the heading's line.
    """
    from corvane.operators.spans import CHUNK, along, spread

    head = ~F.left("value", F.lit(1)).isin(":", ";", "#", " ")
    marked = lines.select("path", "line", "value", F.when(head, F.struct(F.col("line").alias("at"), F.col("value").alias("heading"))).alias("__h"))
    under = along(spread(marked, ["path"], ["line"]), ["path"], ["line"], lasts={"__under": F.col("__h")}).drop(CHUNK)
    found = under.where(F.startswith("value", F.lit(":")) & F.col("__under").isNotNull())
    digits = F.regexp_extract("value", "^:([0-9a-f]*)", 1)
    rest = F.substring("value", F.length(digits) + 2, F.length("value"))
    key = F.left(digits, (F.length(digits) - F.length(digits) % 2).cast("int"))
    return found.select("path", F.col("__under.at").alias("section"), F.col("__under.heading").alias("heading"), "line", key.alias("key"), F.left(F.substring(rest, F.lit(2), F.length(rest)), F.lit(NAME)).alias("name"))


def listed(entries: DataFrame, games: DataFrame) -> DataFrame:
    """(path, game, ord, key, name, heading): what the reader lists for each game (game, parent): the entries under every
    heading that begins with its name or its parent's. A key keeps its first place and takes its last name and heading.

    Headings' beginnings are joined by equality, as many as a name may have characters.
    """
    wanted = games.select("game", F.explode(F.array_distinct(F.array_compact(F.array("game", "parent")))).alias("__begin")).where("length(__begin) > 0").distinct()
    longest = wanted.agg(F.coalesce(F.max(F.length("__begin")), F.lit(0))).first()[0]
    headings = entries.select("path", "section", "heading").distinct()
    cuts = headings.withColumn("__begin", F.explode(F.when(F.length("heading") > 0, F.transform(F.sequence(F.lit(1), F.least(F.length("heading"), F.lit(max(1, longest)))), lambda n: F.left("heading", n)))))
    sections = cuts.join(wanted, "__begin").select("path", "section", "game").distinct()
    met = entries.join(sections, ["path", "section"])
    last = met.groupBy("path", "game", "key").agg(F.min("line").alias("ord"), F.max(F.struct("line", "name", "heading")).alias("m"))
    return last.select("path", "game", "ord", "key", F.col("m.name").alias("name"), F.col("m.heading").alias("heading"))


def fitted(line: Column, most: int = LINE) -> Column:
    """A line cut to whole characters of `most` bytes, without blanks at its cut end."""
    cut = F.aggregate(F.split(line, ""), F.struct(F.lit("").alias("now"), F.lit(False).alias("full")), lambda s, c: F.struct(F.when(s["full"] | (F.octet_length(s["now"]) + F.octet_length(c) > most), s["now"]).otherwise(F.concat(s["now"], c)).alias("now"), (s["full"] | (F.octet_length(s["now"]) + F.octet_length(c) > most)).alias("full")), lambda s: F.rtrim(s["now"]))
    return F.when(F.octet_length(line) <= most, line).otherwise(cut)


def entry_line(key: Column, name: Column) -> Column:
    """`:key:name`, the key in lower-case hex, cut so that its reader reads it whole."""
    return fitted(F.concat(F.lit(":"), F.lower(key), F.lit(":"), F.coalesce(name, F.lit(""))))


def comment_lines(text: Column, lead: str = "; ", most: int = LINE) -> Column:
    """A comment as lines of at most `most` bytes that begin with `lead`, filled word by word; a word that is longer than a
    line is cut. An empty text has no lines."""
    none = F.array().cast("array<string>")

    def put(s: Column, word: Column) -> Column:
        fits = F.octet_length(s["now"]) + 1 + F.octet_length(word) <= most
        new = fitted(F.concat(F.lit(lead), word), most)
        return F.when(s["now"] == "", F.struct(s["done"].alias("done"), new.alias("now"))).when(fits, F.struct(s["done"].alias("done"), F.concat(s["now"], F.lit(" "), word).alias("now"))).otherwise(F.struct(F.array_append(s["done"], s["now"]).alias("done"), new.alias("now")))

    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.struct(none.alias("done"), F.lit("").alias("now")), put, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.array_append(s["done"], s["now"])))


def dictionary_text(sections: DataFrame, entries: DataFrame) -> DataFrame:
    """(heading, part, ord, value): the lines of each section (heading, comment): an empty line, its comment, its heading
    with a colon, and its entries (heading, key, name) by key. Sorted by the first three columns they are the file's text;
    a section without entries is left out."""
    used = sections.join(entries.select("heading").distinct(), "heading", "left_semi")
    tops = used.select("heading", F.lit(0).alias("part"), F.posexplode(F.concat(F.array(F.lit("")), comment_lines(F.col("comment")), F.array(F.concat("heading", F.lit(":"))))).alias("place", "value"))
    tops = tops.select("heading", "part", F.lpad(F.col("place").cast("string"), 9, "0").alias("ord"), "value")
    rows = entries.join(used.select("heading"), "heading", "left_semi").select("heading", F.lit(1).alias("part"), F.lower("key").alias("ord"), entry_line(F.col("key"), F.col("name")).alias("value"))
    return tops.unionByName(rows)
