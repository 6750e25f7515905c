"""Framing of commands: cases by hand, and the search for keys against a search of every byte, pair and stretch."""

import random

from pyspark.sql import functions as F

from corvane.functions import framing as P

FAMILIES = [*P.FRAMES, "DCS", "DCSP2K", "WPCS", "WMSS67", "BYSNT", "TABART", "BY45", "BY56", "CAPCOMS"]
ROW = "at long, family string, data array<int>, two boolean, tbl boolean, after boolean, control boolean, subtype int, strobe boolean"


def hints():
    return P.Hints(*map(F.col, ("tbl", "after", "control", "subtype", "strobe")))


def run(spark, column, rows):
    full = [(i, *r, *(False, False, False, False, 0, False)[len(r) - 2 :]) for i, r in enumerate(rows)]
    return [r[0] for r in spark.createDataFrame(full, ROW).select("at", column.alias("v")).orderBy("at").select("v").collect()]


def sends(family, data, tbl=False, after=False, control=False, subtype=0):
    """A plain walk over the bytes."""
    idle = 0x7F if subtype & 1 else 0x5F if subtype & 4 else 0x1F
    if family == "DCS" and len(data) % 2 or family in ("DCSP2K", "TABART", "BY56") or family == "WMSS67" and control and 0x80 in data:
        return None
    if family == "WPCS":
        return [0, *data] if len(data) == 1 else None if len(data) % 2 else data
    if family == "BYSNT":
        return [6, 4] if data == [6] else data
    out = []
    for b in data:
        if family == "ZAC1370":
            out += [b & 127, b, b & 127] if b > 127 else [b]
        elif family in ("SPINB", "INDER"):
            out += [b, 0] if b > 127 else [b]
        elif family == "GPSM3" or family == "GPSM" and tbl:
            out += [15, b % 16, b // 16, 15]
        elif family == "GPSM":
            out += [b] if b % 16 == 15 else [15, b % 16, 15]
        elif family == "JVH" and after:
            out += [b] if b % 64 == 63 else [b, 63]
        elif family in ("GTS80", "GTS80SS", "ZAC1346"):
            out += [b, 0] if b else [0]
        elif family == "PLAYZ":
            out += [0, b, 0] if b // 16 % 8 else [b]
        elif family == "WMSS67":
            out += [b] if b & idle == idle else [255, b, 255]
        else:
            out.append(b)
    return out


def key(sent, family, **h):
    if len(sent) > 1:
        n = len(sent)
        tried = [[b] for b in range(256)] + [[sent[i], sent[j]] for i in range(n) for j in range(i + 1, n)] + [sent[i : i + k] for k in range(2, n) for i in range(n - k + 1)]
        for c in tried:
            if sends(family, c, **h) == sent:
                return c
    if family == "WPCS" and len(sent) == 3 and sent[1] == 0x7A:
        return sent[1:]
    if family == "WMSS67":
        idle = 0x7F if h.get("subtype", 0) & 1 else 0x5F if h.get("subtype", 0) & 4 else 0x1F
        while len(sent) > 1 and sent[-1] & idle == idle:
            sent = sent[:-1]
        while len(sent) > 1 and sent[0] & idle == idle:
            sent = sent[1:]
    return sent


def test_commander(spark):
    capcom = [0xDA, 4, 7, 15, 0, 1]
    rows = [
        ("DCS", [1, 0x86]), ("DCS", [1]), ("WPCS", [0x2A]), ("WPCS", [0x7A, 5]), ("WMSS11C", [1, 0x22], True), ("WMSS11", [0, 0x7A, 5], True), ("WMSS11", [1, 0x7A, 1, 5], True),
        ("GTS80", [3]), ("ZAC1370", [0xFE]), ("WMSS67", [5]), ("CAPCOMS", capcom), ("CAPCOMS", [0, *capcom], True), ("TABART", [1]), ("DCSP2K", [0, 1]), ("WMSS11", [1], True), ("BYSNT", [6]),
    ]
    got = run(spark, P.commander(F.col("family"), F.col("data"), F.col("two"), hints()), rows)
    assert [r["bytes"] for r in got] == [
        [1, 0x86], None, [0, 0x2A], [0x7A, 5], [1, 0x22], [0, 0x7A, 0, 5], [1, 0x7A, 1, 5], [3, 0], [0x7E, 0xFE, 0x7E], [0xFF, 5, 0xFF], capcom, None, None, None, None, [6, 4],
    ]
    assert [r["reason"] for r in got if r["reason"]] == [P.ODD, P.TOO_MANY, P.DATA_PORT, P.WORDS, P.NO_BOARD]
    assert all((r["bytes"] is None) == (r["reason"] is not None) for r in got)


def test_frames_against_a_walk(spark):
    rng = random.Random(7)
    rows = []
    for family in FAMILIES:
        for _ in range(25):
            data = [rng.choice([0, 4, 6, 15, 0x3F, 0x7A, 0x80, 0xFF, rng.randrange(256)]) for _ in range(rng.randrange(0, 5))]
            rows.append((family, data, False, rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.5, rng.choice([0, 1, 4, 5])))
    got = run(spark, P.framed_bytes(F.col("family"), F.col("data"), hints()), rows)
    assert got == [sends(f, d, t, a, c, s) for f, d, _, t, a, c, s in rows]


def test_idle_bytes_around_a_key(spark):
    rows = [("", d, False, False, False, False, s) for s, d in [(0, [0xFF, 0, 0xFF]), (0, [0]), (0, [0xFF, 5]), (0, [0xFF]), (0, [0xFF, 0xFF]), (1, [0x7F, 0x10, 0x7F]), (0, [])]]
    assert run(spark, P.without_idle(F.col("data"), F.col("subtype")), rows) == [[0], [0], [5], [0xFF], [0xFF], [0x10], []]


def test_keys_against_every_candidate(spark):
    rng = random.Random(11)
    rows = []
    for family in FAMILIES:
        for _ in range(30):
            h = (rng.random() < 0.5, rng.random() < 0.5, rng.random() < 0.3, rng.choice([0, 1, 4]))
            data = [rng.choice([0, 6, 15, 0x3F, 0x7A, 0x80, rng.randrange(256)]) for _ in range(rng.randrange(1, 4))]
            sent = sends(family, data, *h) if rng.random() < 0.7 else data
            rows.append((family, sent or data, False, *h))
    got = run(spark, P.key_of(F.col("data"), F.col("family"), F.col("two"), hints()), rows)
    for row, found in zip(rows, got):
        f, d, _, t, a, c, s = row
        assert found == key(d, f, tbl=t, after=a, control=c, subtype=s), row
    assert run(spark, P.key_of(F.col("data"), F.col("family"), F.col("two"), hints()), [("GTS80", [1, 3, 1, 0], True), ("GTS80", None), (None, [1, 2])]) == [[1, 3, 1, 0], None, [1, 2]]


def test_hints(spark):
    h = P.hints_of(F.col("n"), F.col("s"))
    rows = [("a command table; the control line", "ctrl_w(0,FF)"), ("idle 3F, 5F = idle", None), ("7F = idle, 5F = idle", ""), (None, None)]
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, s string").orderBy("i").select(*h).collect()
    assert [tuple(r) for r in got] == [(True, False, True, 0, True), (False, True, False, 4, False), (False, False, False, 1, False), (False, False, False, 0, False)]
