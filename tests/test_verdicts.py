"""Verdicts, names and packs on small tables with odd rows; operators of hot groups against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from corvane import session
from corvane.operators import grouping as G
from corvane.operators import matching as M
from corvane.operators import naming as N
from corvane.operators import packs as P
from corvane.operators import sequences as Q
from corvane.operators import signals, spans
from corvane.operators import verdicts as V
from corvane.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


SETS = "unit int, ord int, set string, parent string, system boolean, status string, unverified string, renamed string, folders array<string>"


def test_unit_verdicts(spark):
    units = spark.createDataFrame([(1, "Abc", False), (2, "zz", True), (3, "x", False), (4, "sys", False), (5, "fam", False), (6, "one", False)], "unit int, stem string, support boolean")
    sets = [x + (["", "in"] if x[2] == "a" else None,) for x in [(1, 1, "abc", None, False, "good", None, None), (4, 1, "sys", None, True, "good", None, None), (5, 2, "a", "fam", False, "split", "u1", None), (5, 1, "b", "fam", False, "bad-dump", None, "r1"), (6, 1, "two", None, False, "bad-dump", "u6", "r6")]]
    extras = spark.createDataFrame([(1, "m2", "unknown", None), (1, "m1", "unknown", None), (1, "m3", "duplicate", None)], "unit int, member string, kind string, other string")
    got = {u: (s, i) for u, s, i in rows(V.unit_verdicts(units, spark.createDataFrame(sets, SETS), extras), "unit")}
    assert got[1] == ("ok", ["unknown files: m1, m2", "extra files: m3 (duplicate)"])
    assert got[2] == ("support", ["support file, no set"]) and got[3] == ("unknown", ["no file of any set"])
    assert got[4] == ("support", ["system files: sys"])
    assert got[5] == ("split", ["merged: holds 2 sets (b, a)", "files under another name: r1", "not verifiable: u1", "subfolder: a is in in/"])
    assert got[6] == ("bad-dump", ["misnamed: named one, holds two", "not verifiable: u6", "files under another name: r6"])
    none = spark.createDataFrame([], SETS)
    assert V.unit_verdicts(units.limit(0), none, extras.limit(0)).count() == 0
    assert V.best_sets(units, none, V.unit_verdicts(units, none, extras)).count() == 0


def test_measured_sets_of_ties_and_nulls(spark):
    sets = spark.createDataFrame([("e", 1, 1, 9), ("e", 2, 2, None), ("e", 3, 3, None), ("f", 1, 4, None)], "entry string, ord int, set int, parent int")
    runs = spark.createDataFrame([(1, -10.0, "a", None), (2, -11.0, None, "b"), (3, None, None, "c"), (4, None, None, None)], "set int, figure double, volume string, boot_volume string")
    got = rows(V.measured_sets(sets, runs, "entry"), "set")
    assert [(r[1], r[2], r[3]) for r in got] == [(1, "differs", -10.0), (2, "measured", -11.0), (3, "differs", None)]
    assert got[2][4].startswith("its volume differs from 2") and got[0][4] is None


def test_runs_without_a_measurement(spark):
    now = '{"version": "2", "k": "1"}'
    assert [one(spark, V.is_current(F.lit(x).cast("string"), now)) for x in ('{"k": "1", "version": "7"}', '{"k": 1}', "junk", None, "{}")] == [True, True, False, False, False]
    assert one(spark, V.is_done(F.lit('{"k": "1", "version": "2"}'), now, False, F.lit(None), F.lit(None).cast("int"))) is False
    assert one(spark, V.is_done(F.lit('{"version": "2", "k": "1"}'), now, True, F.lit(None), F.lit(0))) is True


def test_names_by_number_and_conflicts(spark):
    sounds = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id long, name string")
    names = spark.createDataFrame([("0x0001", 1, "b"), (" 1 ", 2, "b"), ("2", 3, "x"), ("0X3", 4, "c"), ("3", 5, "d"), ("9", 6, "y"), ("zz", 7, "z")], "text string, ord int, name string")
    assert rows(N.applied_names(sounds, names)) == [(1, "changed", "a", "b"), (2, "changed", None, "x"), (3, "conflict", "c", None), (9, "unknown", None, "y")]
    guard = lambda a, b, r, q: one(spark, N.name_guard(F.lit(a), F.lit(b), F.lit(r), F.lit(q), False))
    assert [guard("A", "a", "r", "q"), guard("a", "b", "r", "r"), guard(None, "b", "r", "q"), guard(None, None, "r", "r")] == ["ok", "refused", "warned", "ok"]


def test_marks_are_idempotent(spark):
    entries = spark.createDataFrame([(1, "l"), (2, "m")], "i int, label string")
    labels, reasons = spark.createDataFrame([("l", "k")], "label string, key string"), spark.createDataFrame([("k", "newer", "t")], "key string, state string, text string")
    first = N.marked_playable(entries, labels, reasons)
    assert rows(first, "i") == [(1, "l", "newer", "t"), (2, "m", "yes", None)] == rows(N.marked_playable(first, labels, reasons), "i")


def test_pack_formats(spark):
    assert [one(spark, P.byte_list(F.lit(x))) for x in ("0xabc", "ff", "", "g")] == ["0ABC", "FF", None, None] and one(spark, P.byte_list(F.lit("abc"), True)) is None
    assert [one(spark, P.human_bytes(F.lit(n))) for n in (0, 1023, 1024, 1536, 1025, 5 << 20, (5 << 20) + 1, 1_179_648, 3 << 30)] == ["0 B", "1023 B", "1 KiB", "1.5 KiB", "1.0 KiB", "5 MiB", "5.00 MiB", "1.13 MiB", "3072 MiB"]
    assert [one(spark, P.grouped_digits(F.lit(n), " ")) for n in (0, 999, 1000, 1234567)] == ["0", "999", "1 000", "1 234 567"]
    base = "no exact repetition within 31 s (the period must hold over two cycles and at least 20 s)"
    told = lambda *x: one(spark, P.unresolved_reason(F.lit(31.2), *[F.lit(v).cast(k) for v, k in zip(x, ("string", "string", "double", "double", "string"))]))
    assert told(None, None, None, None, None) == base and told("n", None, None, None, "r") == base + "; n"
    assert told(None, "loops", 2.5, None, "r") == base + "; the program repeats every 2.500 s, which the audio did not confirm (r)"
    assert told(None, "loops", None, None, "r") == base + "; program: r (r)" and told(None, "ends", None, 1.0, "r") == base + "; the program ends after 1.000 s"
    assert told(None, "unreadable", None, None, "r") == base + "; program: r"
    assert one(spark, P.whole_cycles(F.lit(2.5), 9, 0.05)) == 2 and one(spark, P.whole_cycles(F.lit(0.37), 2, 0.01)) is None
    assert tuple(one(spark, P.search_cap(F.lit(1.0), F.lit(3.0)))) == (20.0, 26.0, True)


def plain_leaders(pairs):
    twin = {}
    for a, b in sorted(pairs, key=lambda p: (p[1], p[0])):
        if b not in twin and a not in twin:
            twin[b] = a
    return sorted((b, a) for b, a in twin.items())


@pytest.mark.parametrize("seed", range(3))
def test_leaders_against_a_walk(spark, seed):
    rng = random.Random(seed)
    pairs = list({tuple(sorted(rng.sample(range(60), 2))) for _ in range(90)}) + [(i, i + 1) for i in range(70, 80)]
    df = spark.createDataFrame([(0, a, b) for a, b in pairs], "k int, a int, b int")
    assert [r[1:] for r in rows(M.leaders(df, ["k"]), "item")] == plain_leaders(pairs)
    assert M.leaders(df.limit(0), ["k"]).count() == 0


def test_order_statistics_by_ranges(spark, monkeypatch):
    rng = random.Random(4)
    df = spark.createDataFrame([(k, rng.uniform(-9, 9)) for k in (0, 0, 0, 1) for _ in range(300)] + [(2, None)], "k int, v double")
    whole = rows(G.order_statistics(df, ["k"], "v", {"u": G.UPPER_MIDDLE, "p": G.P99_INDEX}))
    monkeypatch.setattr(spans, "ROWS_OF_A_KEY", 10)
    assert rows(G.order_statistics(df, ["k"], "v", {"u": G.UPPER_MIDDLE, "p": G.P99_INDEX})) == whole and len(whole) == 2


def test_decayed_by_parts(spark):
    rng = random.Random(1)
    x = [rng.uniform(-1, 1) for _ in range(950)]
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate(x)], "k int, i int, v double")
    r, want = math.exp(-0.2), [0.0]
    for a, b in zip(x, x[1:]):
        want.append(b - a + r * want[-1])
    got = [y for _, _, y in rows(Q.decayed(df, ["k"], ["i"], "v", r, part=300), "i")]
    assert got == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        Q.decayed(df, ["k"], ["i"], "v", r, part=10)


def test_lags_of_gaps_and_repeats(spark):
    df = spark.createDataFrame([(0, 0, 1), (0, 1, 4), (0, 1, 5), (0, 3, 9)], "k int, i int, v int")
    assert rows(Q.lag_difference(df, ["k"], "i", "v", 3)) == [(0, 1, 2, 7), (0, 2, 2, 9), (0, 3, 1, 8)]


def test_streams_in_parts_decode_alike(monkeypatch):
    rng = random.Random(2)
    streams = [bytes(rng.randrange(256) for _ in range(rng.randrange(1, 90))) for _ in range(60)]
    monkeypatch.setattr(signals, "TOGETHER", 128)
    assert [x.tolist() for x in signals.ima_decode_all(streams)] == [signals.ima_decode(x).tolist() for x in streams]


def test_twin_leaders_against_a_walk(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type", "value", "event_id").collect()
    want = {}
    for k in {(e.user_id, e.event_type) for e in events}:
        mine = [e for e in events if (e.user_id, e.event_type) == k]
        pairs = [(a.event_id, b.event_id) for a in mine for b in mine if a.event_id < b.event_id and abs(a.value - b.value) <= 0.5]
        want |= {(*k, b): a for b, a in plain_leaders(pairs)}
    assert {(r.user_id, r.event_type, r.item): r.leader for r in QUERIES["twin_leaders"](spark, SF).collect()} == want


def test_no_shared_folder_on_a_cluster():
    class Context:
        master, applicationId = "spark://somewhere:7077", "x"

    class Conf:
        @staticmethod
        def get(key, otherwise=None):
            return otherwise

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Session())


def test_levels_of_a_stepped_volume_are_kept_apart(spark):
    schema = "k int, decoded boolean, complete boolean, volume_mode string, dead_from string, borrowed boolean, unscaled boolean, stepped boolean, v double"
    given = [(1, False, True, "factory", None, False, False, False, 1.0), (2, False, True, "factory", None, False, True, True, 2.0), (3, True, True, "factory", None, False, True, None, 3.0), (4, False, True, "factory", None, False, True, None, 4.0), (5, True, False, "x", None, False, False, True, 5.0)]
    got = {r["k"]: (r["main"], r["static"], r["at_reference"], r["caveat"]) for r in V.loudness_slots(spark.createDataFrame(given, schema), "v").collect()}
    step = "not at the game's level: the step volume stands where it was at power-on"
    assert got[1] == (1.0, None, None, None) and got[2] == (None, None, 2.0, step) and got[4] == (None, None, 4.0, "the factory offset could not be measured")
    assert got[3] == (None, 3.0, None, "decoded, not measured in a game") and got[5] == (None, 5.0, None, f"decoded, not measured in a game; a partial run; {step}")
    rows_ = [("a", 2, 0, "f", "v", "o"), ("a", 1, 1, "g", "w", "p"), ("b", 1, None, "f", "v", "o")]
    texts = {r[0]: r[1] for r in V.recorded_volumes(spark.createDataFrame(rows_, "k string, ord int, board int, family string, volume string, origin string"), "k").collect()}
    assert texts == {"a": ["board 1 (g): w: p", "board 0 (f): v: o"], "b": []}


def test_rows_from_programs(spark):
    rows_ = P.plain_rows(spark.createDataFrame([("g", i, "music" if i == 7 else "sfx", i == 1, False) for i in range(1, 9)], "pack string, id int, kind string, looped boolean, continuous boolean"))
    shape = "pack string, id int, type int, channel int, streams array<int>, ducks array<struct<channel:int,units:double>>, stops array<int>, error string"
    given = [
        ("g", 1, 1, 0, [0], [(0, -9.0)], [0], None), ("g", 2, 1, 0, [0], [], [], None), ("g", 3, 1, 2, [2], [(1, -90.0), (0, -20.0)], [0], None), ("g", 4, 1, 3, [3], [(0, 5.0)], [0], None),
        ("g", 5, 2, 2, [], [], [3], None), ("g", 6, 1, 2, [2], [(0, -4.0)], [0], "unknown opcode"), ("g", 8, 1, 0, [4], None, None, None),
    ]
    programs = spark.createDataFrame(given, shape)
    out = P.program_rows(rows_, programs, spark.createDataFrame([("g", 2)], "pack string, voice int"), "pack")
    got = {r["id"]: (r["channel"], r["duck"], r["gtype"], r["stop"], r["lost_stop"]) for r in out.collect()}
    assert got == {
        1: (0, 100, "MUSIC", False, False), 2: (0, 100, "SFX", False, False), 3: (1, round(100 * 0.9733**20), "CALLOUT", True, False), 4: (-1, 100, "SFX", False, True),
        5: (1, 100, "CALLOUT", False, False), 6: (-1, 100, "SFX", False, False), 7: (0, 100, "SFX", False, False), 8: (-1, 100, "SFX", False, False),
    }
    assert rows(P.pack_limits(out, "pack")) == [("g", "0x0004")]
    none = P.program_rows(rows_, programs, spark.createDataFrame([], "pack string, voice int"), "pack")
    assert {r["channel"] for r in none.where("gtype = 'SFX' and id > 2 and id != 7").collect()} == {-1}
    assert rows(P.channel_summary(programs, "pack")) == [("g", 0, 3, 3, 1), ("g", 2, 2, 2, 2), ("g", 3, 1, 1, 0)]
    assert {(r["id"], r["list"]): (r["channels"], r["note"]) for r in P.program_lists(programs, "pack", 5).collect()} == {(5, "stop"): ([3], "built in"), (5, "deferred"): ([2], None), (6, "unreadable"): (None, None)}
    assert P.program_lists(programs, "pack", 9).where("list = 'stop'").first()["note"] == "lost: a voice or an effect cannot be stopped"
