"""How boards take commands: the bytes that go out for a command, what a commander sends for an id, and the key of sent bytes.

Bytes are arrays of int, 0 to 255. Everything is one expression a row: no rows are multiplied and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Dress(NamedTuple):
    """A byte whose bits under `mask` are `bare` goes out as it is, any other one as its pieces."""

    mask: int
    bare: int
    pieces: Callable[[Column], list[Column]]


def _between(first: int | None, last: int | None) -> Callable[[Column], list[Column]]:
    return lambda b: [F.lit(first)] * (first is not None) + [b] + [F.lit(last)] * (last is not None)


_low = lambda b: b.bitwiseAND(F.lit(15))
_nibbles = lambda b: [F.lit(15), _low(b), F.shiftright(b, 4), F.lit(15)]

# How each family's boards are addressed, its idle bytes, and what a commander cannot send.
FRAMES = {
    "ZAC1370": Dress(0x80, 0x00, lambda b: [b.bitwiseAND(F.lit(127)), b, b.bitwiseAND(F.lit(127))]),
    "SPINB": Dress(0x80, 0x00, _between(None, 0x00)),
    "INDER": Dress(0x80, 0x00, _between(None, 0x00)),
    "GPSM": Dress(0x0F, 0x0F, lambda b: [F.lit(15), _low(b), F.lit(15)]),
    "GPSM3": Dress(0x00, 0x01, _nibbles),
    "JVH": Dress(0x3F, 0x3F, _between(None, 0x3F)),
    "GTS80": Dress(0xFF, 0x00, _between(None, 0x00)),
    "GTS80SS": Dress(0xFF, 0x00, _between(None, 0x00)),
    "ZAC1346": Dress(0xFF, 0x00, _between(None, 0x00)),
    "PLAYZ": Dress(0x70, 0x00, _between(0x00, 0x00)),
}
#: Idle bits of a System 3 to 7 board by its sub-type, and the byte between its commands.
IDLE_BITS, IDLE_BYTE = {1: 0x7F, 4: 0x5F, 0: 0x1F}, 0xFF
CONTROL_LINE, BANK, BACKGROUND, NO_OPERATION = 0x80, 0x7A, 0x06, 0x04
MOST_BYTES = 6
ODD = "DCS: an odd number of bytes"
WORDS = "Pinball 2000: the board takes 16-bit words"
ODD_REST = "WPCS: an odd number of bytes after the first"
PULSE = "System 3: a pulse of the control line"
DATA_PORT = "Tabart: the commands go through the data port"
STROBE = "Baby Pac-Man's board: nibbles with a strobe"
TWO_NIBBLES = "two nibbles on the same lines"
NO_BOARD = "an id without its board"
TOO_MANY = "more than the 6 bytes of an entry"
HINTS = [("table", "command table"), ("idle_after", "idle 3F"), ("control", "the control line"), ("idle_7f", "7F = idle"), ("idle_5f", "5F = idle")]
STROBE_HINT = "ctrl_w"


class Hints(NamedTuple):
    """What a report says of a board beyond its family: a table of bytes, an idle byte after each command, a control line,
    the sub-type that sets the idle bits, and a strobe. All columns; false and 0 where nothing is known."""

    table: Column
    idle_after: Column
    control: Column
    subtype: Column
    strobe: Column


def no_hints() -> Hints:
    return Hints(F.lit(False), F.lit(False), F.lit(False), F.lit(0), F.lit(False))


def hints_of(notes: Column, stop: Column) -> Hints:
    """Hints from a report's free notes and from how it stops sounds; null texts hint at nothing."""
    said = {name: F.coalesce(F.contains(notes, F.lit(text)), F.lit(False)) for name, text in HINTS}
    subtype = F.when(said["idle_7f"], 1).when(said["idle_5f"], 4).otherwise(0)
    return Hints(said["table"], said["idle_after"], said["control"], subtype, F.coalesce(F.contains(stop, F.lit(STROBE_HINT)), F.lit(False)))


def dressed(data: Column, style: Dress) -> Column:
    """Each byte of `data` as `style` sends it."""
    return F.flatten(F.transform(data, lambda b: F.when(b.bitwiseAND(F.lit(style.mask)) == style.bare, F.array(b)).otherwise(F.array(*style.pieces(b)))))


def _idle(subtype: Column, b: Column) -> Column:
    """Whether a System 3 to 7 board takes a byte for an idle one: the lowest bit of its sub-type decides first."""
    bits = F.when(subtype.bitwiseAND(F.lit(1)) != 0, IDLE_BITS[1]).when(subtype.bitwiseAND(F.lit(4)) != 0, IDLE_BITS[4]).otherwise(IDLE_BITS[0])
    return b.bitwiseAND(bits) == bits


def between_idle(data: Column, subtype: Column) -> Column:
    return F.flatten(F.transform(data, lambda b: F.when(_idle(subtype, b), F.array(b)).otherwise(F.array(F.lit(IDLE_BYTE), b, F.lit(IDLE_BYTE)))))


def without_idle(data: Column, subtype: Column) -> Column:
    """Sent bytes without the idle ones at both ends; of idle bytes alone the first is left."""
    at = F.filter(F.sequence(F.lit(1), F.size(data)), lambda i: ~_idle(subtype, F.element_at(data, i)))
    inner = F.slice(data, at[0], F.element_at(at, -1) - at[0] + 1)
    return F.when(F.size(data) == 0, data).when(F.size(at) == 0, F.slice(data, 1, 1)).otherwise(inner)


def _refusal(family: Column, data: Column, h: Hints) -> Column:
    odd = F.size(data) % 2 == 1
    return (
        F.when((family == "DCS") & odd, ODD)
        .when(family == "DCSP2K", WORDS)
        .when((family == "WPCS") & odd & (F.size(data) > 1), ODD_REST)
        .when((family == "WMSS67") & h.control & F.array_contains(data, CONTROL_LINE), PULSE)
        .when(family == "TABART", DATA_PORT)
        .when((family == "BY45") & h.strobe, STROBE)
        .when(family.isin("BY56", "BY51N"), TWO_NIBBLES)
    )


def framed_bytes(family: Column, data: Column, h: Hints) -> Column:
    """The bytes that go out for a command of a family; null where it cannot be sent. A null family has no frame."""
    out = F.when((family == "WPCS") & (F.size(data) == 1), F.array(F.lit(0), data[0]))
    out = out.when((family == "GPSM") & h.table, dressed(data, FRAMES["GPSM3"]))
    for name, style in FRAMES.items():
        out = out.when((family == name) & h.idle_after if name == "JVH" else family == name, dressed(data, style))
    out = out.when(family == "WMSS67", between_idle(data, h.subtype))
    out = out.when((family == "BYSNT") & (data == F.array(F.lit(BACKGROUND))), F.array(F.lit(BACKGROUND), F.lit(NO_OPERATION)))
    return F.when(_refusal(family, data, h).isNull(), out.otherwise(data))


def framed(family: Column, data: Column, h: Hints) -> Column:
    """struct(bytes, reason): the bytes that go out for a command, or why it cannot be sent."""
    return F.struct(framed_bytes(family, data, h).alias("bytes"), _refusal(family, data, h).alias("reason"))


def commander(family: Column, id: Column, two_boards: Column, h: Hints) -> Column:
    """struct(bytes, reason): what a commander sends for an id, six bytes at most. On two boards the id is a board and its
    bytes, or pairs of a board and a byte already, and each byte goes out after its board."""
    places = F.sequence(F.lit(0), F.size(id) - 1)
    boards = F.filter(id, lambda b, i: i % 2 == 0)
    pairs = (F.size(id) >= 4) & (F.size(id) % 2 == 0) & (id[0] <= 1) & F.forall(boards, lambda b: b == id[0])
    data = F.when(~two_boards, id).when(pairs, F.filter(id, lambda b, i: i % 2 == 1)).when(F.size(id) > 1, F.slice(id, 2, F.size(places)))
    plain = framed_bytes(family, data, h)
    out = F.when(two_boards, F.flatten(F.transform(plain, lambda b: F.array(id[0], b)))).otherwise(plain)
    reason = F.when(data.isNull() & id.isNotNull(), NO_BOARD).otherwise(F.coalesce(_refusal(family, data, h), F.when(F.size(out) > MOST_BYTES, TOO_MANY)))
    return F.struct(F.when(reason.isNull(), out).alias("bytes"), reason.alias("reason"))


def key_of(sent: Column, family: Column, two_boards: Column, h: Hints) -> Column:
    """The command whose frame the sent bytes are: the smallest single byte, else the first pair of them in order, else the
    shortest stretch of them; where none is, the bytes without a bank's filler, or without idle bytes. On two boards, and
    for a single byte, nothing is searched.

    A single byte that is framed so is among the sent bytes, or made of two that follow each other as nibbles, so no other
    one is tried.
    """
    n = F.size(sent)
    count = lambda k: F.when(k > 0, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>"))
    at = lambda i: F.element_at(sent, i)
    made = F.transform(count(n - 1), lambda i: at(i).bitwiseAND(F.lit(15)).bitwiseOR(F.shiftleft(at(i + 1).bitwiseAND(F.lit(15)), 4)))
    singles = F.transform(F.array_sort(F.array_union(sent, made)), lambda b: F.array(b))
    pairs = F.flatten(F.transform(count(n - 1), lambda i: F.transform(F.sequence(i + 1, n), lambda j: F.array(at(i), at(j)))))
    stretches = F.flatten(F.transform(F.slice(count(n - 1), 2, n), lambda k: F.transform(count(n - k + 1), lambda i: F.slice(sent, i, k))))
    found = F.get(F.filter(F.concat(singles, pairs, stretches), lambda c: F.coalesce(framed_bytes(family, c, h) == sent, F.lit(False))), 0)
    rest = F.when((family == "WPCS") & (n == 3) & (at(2) == BANK), F.slice(sent, 2, 2)).when(family == "WMSS67", without_idle(sent, h.subtype)).otherwise(sent)
    return F.when(two_boards, sent).otherwise(F.coalesce(F.when(n > 1, found), rest))


def hex_of(data: Column) -> Column:
    """Bytes as upper-case hex digits."""
    return F.array_join(F.transform(data, lambda b: F.format_string("%02X", b)), "")
