"""Scalar rules as column expressions: ids, names, framing, levels, rounding. Null in, null out unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ABSOLUTE_GATE, RELATIVE_GATE, OFFSET = -70.0, -10.0, -0.691
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rounded(x: Column, digits: int) -> Column:
    """Half away from zero on the binary value, unlike round(), which looks at the decimal text."""
    k = float(10**digits)
    return F.signum(x) * F.floor(F.abs(x) * k + 0.5).cast("double") / k


def micros(ts: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts})")


def ascii_lower(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def parse_id(text: Column) -> Column:
    """A hex id of up to eight digits, with or without 0x; null if it is none."""
    digits = F.regexp_extract(text, r"^\s*(?:0[xX])?([0-9A-Fa-f]{1,8})\s*$", 1)
    return F.when(digits != "", F.conv(digits, 16, 10).cast("long"))


def id_text(x: Column) -> Column:
    return F.when(x.isNotNull(), F.format_string("0x%04X", x))


def csv_name(text: Column, otherwise: Column | None = None) -> Column:
    """A name that is safe in an unquoted CSV field: quotes and control characters go, commas become blanks, blanks are
    single. What is empty then is `otherwise`, if that is given."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\"'\p{Cc}]", ""), r"[,\s\p{Z}]+", " ")
    bare = F.trim(bare)
    return bare if otherwise is None else F.when(bare == "", otherwise).otherwise(bare)


def file_name(text: Column, most: int = 80) -> Column:
    """Letters and digits of any script, dashes and underscores; other runs become one underscore."""
    return F.left(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}-]+", "_"), "^_|_$", ""), F.lit(most))


def kept_name(path: Column, most: int = 80) -> Column:
    """The last piece of a path as a name that a pack can hold: letters and digits of any script, blanks and `_.()+-`;
    other characters are underscores. No blank or dot leads, no blank ends."""
    plain = F.trim(F.regexp_replace(base_name(path), r"[^\p{IsAlphabetic}\p{N} _.()+-]", "_"))
    return F.left(F.trim(F.regexp_replace(plain, r"^\.+", "")), F.lit(most))


def normal_id(text: Column) -> Column:
    """An id as it is written in files; a text that is none stays, without blanks at its ends."""
    return F.coalesce(id_text(parse_id(text)), F.trim(text))


def kebab(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"(?<=.)([A-Z])", "-$1"))


def escape_html(text: Column) -> Column:
    for one, other in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(one), F.lit(other))
    return text


def csv_field(text: Column) -> Column:
    """A field by RFC 4180: quoted where it holds a quote, comma or break."""
    return F.when(F.regexp_like(text, F.lit(r'[",\r\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def base_name(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def clean_label(text: Column) -> Column:
    """A name without control characters, blanks single and none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\p{Cc}\s\p{Z}]+", " "))


def same_name(read: Column, name: Column, most: int = 29) -> Column:
    """Whether `read`, a name that its reader cut at `most` characters, is `name`, spacing aside."""
    a, b = clean_label(F.left(read, F.lit(most))), clean_label(F.left(name, F.lit(most)))
    return (a == b) | ((a != "") & clean_label(name).startswith(a))


def energy_to_lufs(energy: Column) -> Column:
    return F.when(energy > 0, OFFSET + 10 * F.log10(energy))


def lufs_to_energy(lufs: Column) -> Column:
    return F.pow(F.lit(10.0), (lufs - OFFSET) / 10)


def gain_percent(db: Column, most: int = 100) -> Column:
    """A linear gain in percent, within 0 and `most`."""
    return F.least(F.greatest(F.floor(F.pow(F.lit(10.0), db / 20) * 100 + 0.5), F.lit(0)), F.lit(most)).cast("int")


def framed(x: Column, lead: int, stop: int) -> Column:
    """A byte between its frame's first and last byte, with its complement: what checked serial protocols send."""
    return F.array(F.lit(lead), x, F.lit(255) - x, F.lit(stop))


def split_nibbles(x: Column) -> Column:
    return F.array(F.shiftright(x, 4), x.bitwiseAND(F.lit(15)))


def extended_cycles(target: Column, intro: Column, period: Column) -> Column:
    """Whole periods that fill `target` after `intro`; one at least."""
    return F.greatest(F.lit(1), F.ceil((target - intro) / period)).cast("int")
