"""Rules and reconciliation on small cases by hand and against plain loops."""

import random

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.functions import rules as R
from corvane.operators import reconcile as C


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at long, " + schema).select("at", column.alias("v")).orderBy("at").select("v").collect()]


def test_kinds(spark):
    rows = [("  MUSIC: a", False, None), ("'x'", False, None), ('"Hi"', False, "sfx"), ("Voice: a", True, None), ("SFX: a", False, "callout"), ("a", False, "callout"), ("", False, None), (None, False, None)]
    got = values(spark, R.kind(F.col("n"), F.col("p"), F.col("h")), rows, "n string, p boolean, h string")
    assert got == ["music", "sfx", "callout", "music", "sfx", "callout", "sfx", "sfx"]


def test_generated_names(spark):
    rows = [("0x2a", 3.24, "silence", None), ("0x2A", 12.5, "silence", "Bell"), ("2a", 119.6, "max", ""), ("2a", 1.0, "loop", None)]
    got = values(spark, R.generated_name(F.col("i"), F.col("s"), F.col("e"), F.col("h")), rows, "i string, s double, e string, h string")
    assert got == ["Sound 2A (3.2 s)", "Sound 2A ~Bell (12 s)", "Sound 2A (120+ s)", "Sound 2A (loop)"]


def test_names(spark):
    assert values(spark, X.csv_name(F.col("n"), F.lit("sound 1")), [("a 'b',\tc",), ('"\n',), (None,)], "n string") == ["a b c", "sound 1", None]
    long = "x" * 40
    assert values(spark, X.same_name(F.col("a"), F.col("b")), [(long[:29], long), ("a  b", "a b"), ("", "b"), ("ab", "abc")], "a string, b string") == [True, True, False, True]


def test_volume_commands(spark):
    rows = [
        ("DCS", [1, 0x55, 0xAA, 0xFF, 0x00]),
        ("DCS", [0x55, 0xAB, 9, 246]),
        ("DCS", [0x55, 0xAA, 9, 9]),
        ("DCSP2K", [0x55, 0xAB, 3, 255]),
        ("DCSP2K", [0x55, 0xAC, 64, 1]),
        ("WPCS", [0x79, 10, 245]),
        ("AT91", [0xFE, 0x10]),
        ("BSMT", [0xFE, 0x30]),
        ("DCS", [0xAA]),
        ("DCS", []),
        ("other", [0x79, 10, 245]),
    ]
    got = values(spark, R.volume_command(F.col("f"), F.col("b")), rows, "f string, b array<int>")
    assert [x and tuple(x) for x in got] == [("master", 255, 31, 31), ("channel AB", 9, 9, 255), None, ("channel volume 03", 255, 31, 31), None, ("master", 10, 10, 31), ("master", 16, 31, 31), None, None, None, None]


def test_labels(spark):
    rows = [(None, True), ("SNDBRD_NONE", True), ("SNDBRD_NONE", False), ("SNDBRD_A+SNDBRD_B+C", False)]
    assert values(spark, R.family_label(F.col("b"), F.col("s")), rows, "b string, s boolean") == ["unknown", "NONE (Stern SAM)", "NONE (other)", "A+B+C"]
    got = values(spark, R.game_version(F.col("n")), [("rfm_210r3",), ("swep1_200m",), ("rfm_x",), ("afm_113b",), (None,)], "n string")
    assert [x and tuple(x) for x in got] == [("rfm", "210"), ("swep1", "200"), None, None, None]


def test_extras(spark):
    rows = [(True, True, "a.txt"), (False, True, "a.txt"), (False, False, "d/A.TXT"), (False, False, "txt"), (False, False, "a.u5")]
    assert values(spark, R.extra_kind(F.col("u"), F.col("o"), F.col("n")), rows, "u boolean, o boolean, n string") == ["duplicate", "rom-of-other-set", "not-a-rom", "unknown", "unknown"]


def test_follow(spark):
    rows = [(5.0, None), (2.0, None), (-2.0, None), (None, 4.0), (0.0, 10.0), (6.0, 10.0), (3.5, 1.0), (4.5, 1.0)]
    assert values(spark, R.ignores_volume(F.col("d"), F.col("r")), rows, "d double, r double") == [False, True, True, False, True, False, False, True]


def test_within_against_loops(spark):
    rng = random.Random(3)
    points = [(rng.randrange(3), rng.randrange(-500, 500)) for _ in range(300)]
    spans = [(i, rng.randrange(3), b, b + rng.choice([-5, 0, 1, 7, 64, 900])) for i, b in enumerate(rng.randrange(-500, 500) for _ in range(80))]
    p = spark.createDataFrame(points, "k int, at long")
    s = spark.createDataFrame(spans, "id int, k int, lo long, hi long")
    got = sorted((r["id"], r["at"]) for r in C.within(p, s, ["k"], "at", "lo", "hi").collect())
    assert got == sorted((i, a) for i, k, lo, hi in spans for kk, a in points if k == kk and lo <= a <= hi)
    assert C.within(p, s.limit(0), ["k"], "at", "lo", "hi").count() == 0


def test_shared_of_a_large_group(spark):
    df = spark.range(2000).select(F.col("id"), F.when(F.col("id") > 0, F.lit("x")).alias("fp"))
    got = {r["id"]: (r["n_others"], r["others"]) for r in C.shared(df, "fp", "id").collect()}
    assert got[0] == (0, []) and got[3] == (1998, [1, 2, 4, 5, 6, 7]) and got[1999] == (1998, [1, 2, 3, 4, 5, 6])


def test_duck_phases(spark):
    levels = {"a": [0, 0, -3, -9, -9, -4, 0, -2], "b": [0, 0, 0], "c": [5, 5]}
    df = spark.createDataFrame([(k, i, v) for k, x in levels.items() for i, v in enumerate(x)], "k string, at long, v long")
    got = {r["k"]: tuple(r)[1:] for r in C.duck_phases(df, ["k"], "at", "v").collect()}
    assert got == {"a": (2, 3, -9, 6, 5), "c": (0, 0, 5, None, None)}
