"""Operators on small tables: ties, nulls, empty groups, rounding, and kernels against known truths."""

import math
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import grouping as G
from corvane.operators import matching as M
from corvane.operators import sequences as Q
from corvane.operators import signals as S
from corvane.sources import archives, sinks, texts


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("x,digits,want", [(1.005, 2, 1.0), (2.5, 0, 3.0), (-2.5, 0, -3.0), (0.0, 3, 0.0), (None, 2, None)])
def test_rounding(spark, x, digits, want):
    assert one(spark, X.rounded(F.lit(x).cast("double"), digits)) == want


def test_scalar_rules(spark):
    assert [one(spark, X.parse_id(F.lit(t))) for t in ("0x1F", "1f", "g", "", "123456789")] == [31, 31, None, None, None]
    assert one(spark, X.csv_name(F.lit('a "b",\n c'))) == "a b c" and one(spark, X.kebab(F.lit("NoSound"))) == "no-sound"
    assert one(spark, X.csv_field(F.lit('a"b'))) == '"a""b"' and one(spark, X.stem(F.lit("a/b\\c.d.zip"))) == "c.d"
    assert one(spark, X.file_name(F.lit(" é/b c! "))) == "é_b_c" and one(spark, X.escape_html(F.lit('<a b="&">'))) == "&lt;a b=&quot;&amp;&quot;&gt;"
    assert one(spark, X.gain_percent(F.lit(6.0))) == 100 and one(spark, X.gain_percent(F.lit(-6.0))) == 50
    assert one(spark, X.energy_to_lufs(X.lufs_to_energy(F.lit(-23.0)))) == pytest.approx(-23)


def test_fingerprint_needs_every_digest(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "a"), (2, None), (3, None)], "k int, d string")
    import hashlib

    assert rows(G.fingerprint(df, ["k"], "d")) == [(1, hashlib.sha1(b"a\nb\n").hexdigest(), 2), (2, None, 1), (3, None, 0)]


def test_order_statistics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 2.0), (1, 3.0), (1, 10.0), (2, 5.0), (3, None)], "k int, v double")
    assert rows(G.median(df, ["k"], "v")) == [(1, 4, 2.5), (2, 1, 5.0)]
    assert rows(G.order_statistics(df, ["k"], "v", {"u": G.UPPER_MIDDLE, "p": G.P99_INDEX})) == [(1, 4, 3.0, 3.0), (2, 1, 5.0, 5.0)]
    assert rows(G.spread_around_upper_median(df, ["k"], "v"))[0] == (1, 4, 3.0, pytest.approx(2 * 1.4826))


def test_gate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 0.05), ("a", 1e-9), ("b", 1e-9), ("c", None)], "k string, e double")
    got = rows(G.gated(df, ["k"], "e"))
    assert got[0][:3] == ("a", 2, 1.0) and got[0][3] == pytest.approx(-0.691) and got[1:] == [("b", 0, None, None), ("c", 0, None, None)]


def test_islands_merge_at_the_gap(spark):
    df = spark.createDataFrame([(1, t, i) for i, t in enumerate([0, 10, 20, 31, 31])], "k int, t long, i int")
    assert rows(Q.islands(df, ["k"], "t", 10, ["i"])) == [(1, 0, 20, 3), (1, 31, 31, 2)]
    assert rows(Q.longest_run(spark.createDataFrame([(1, i, v) for i, v in enumerate(["a", "a", None, None, "b"])], "k int, i int, v string"), ["k"], ["i"], "v")) == [(1, "a", 0, 2)]


def test_identification(spark):
    members = spark.createDataFrame([("u", 0, "A.bin", 1, 10), ("u", 1, "x.bin", 2, 10), ("u", 2, "c.bin", 9, 10), ("u", 3, "ND.bin", 5, 1)], "unit string, ord int, name string, crc long, size long")
    files = spark.createDataFrame([("s", 0, "a.bin", 1, 10, False), ("s", 1, "b.bin", 2, 10, False), ("s", 2, "c.bin", 3, 10, False), ("s", 3, "d.bin", 4, 10, False), ("n", 0, "nd.bin", None, None, True)], "set string, ord int, name string, crc long, size long, no_dump boolean")
    pairs = M.candidates(members, files)
    assert rows(pairs) == [("u", "n"), ("u", "s")]
    found = M.match_files(pairs, members, files)
    assert rows(found, "set", "ord") == [("u", "n", 0, "good", 3), ("u", "s", 0, "good", 0), ("u", "s", 1, "renamed", 1), ("u", "s", 2, "wrong", 2), ("u", "s", 3, "missing", None)]
    assert rows(M.closest(found)) == [("u", "s", 2, 2)] == rows(M.closest_sets(members, files))


def test_leaders_are_no_components(spark):
    pairs = spark.createDataFrame([(0, 1, 2), (0, 2, 3), (0, 3, 4)], "k int, a long, b long")
    # 2 follows 1, so it leads nobody; 3 pairs with 2 alone and stays its own; 4 follows 3.
    assert rows(M.leaders(pairs, ["k"])) == [(0, 2, 1), (0, 4, 3)]


def test_edits(spark):
    base = spark.createDataFrame([(1, "a", 5), (3, "b", 6)], "id long, name string, v int")
    assert rows(M.aliases(base, "id", F.col("id") + 2)) == [(1, "a", 5, False), (3, "b", 6, False), (5, "b", 6, True)]
    again = spark.createDataFrame([(1, "c", 9), (3, "d", 0)], "id long, name string, v int")
    assert rows(M.second_attempt(base, again, "id", F.col("v") > 5)) == [(1, "c", 9, True), (3, "b", 6, True)]
    assert rows(M.without_subsets(spark.createDataFrame([(0, "x", 1), (0, "y", 1), (0, "y", 2), (0, "z", 1), (0, "z", 2)], "k int, n string, e int"), ["k"], "n", "e")) == [(0, "y", 2), (0, "z", 2)]


def tone(level, seconds=2.0, hz=997.0, rate=S.RATE):
    return np.round(np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate) * level * 32767).astype("<i2")


def test_loudness_of_a_tone(spark):
    # A mono tone that counts as two channels: full scale at 997 Hz reads -3.01 + 3.01 LUFS.
    sounds = spark.createDataFrame([("a", tone(0.1).tobytes()), ("b", None), ("c", np.zeros(100, "<i2").tobytes())], "name string, pcm binary")
    got = {r["name"]: r for r in S.loudness(S.measure(sounds), ["name"]).collect()}
    assert got["a"]["lufs"] == pytest.approx(-20.0, abs=0.1) and got["b"]["lufs"] is None and got["c"]["lufs"] is None


def test_filters_against_loops():
    x = np.random.default_rng(0).standard_normal(1000)
    y, carry = [], 0.0
    for v in x:
        carry = v + 0.97 * carry
        y.append(carry)
    assert np.allclose(S.one_pole(x, 0.97), y)
    b, a, out = (0.3, -0.2, 0.1), (1.0, -1.2, 0.5), []
    z1 = z2 = 0.0
    for v in x:
        o = b[0] * v + z1
        z1, z2 = b[1] * v - a[1] * o + z2, b[2] * v - a[2] * o
        out.append(o)
    assert np.allclose(S.biquad(x, b, a), out)


def test_peaks_and_clips():
    quarter = np.round(np.sin(np.pi / 4 + np.pi / 2 * np.arange(400)) * 20000).astype("<i2")
    assert 20 * math.log10(S.true_peak(quarter) * 32768 / 20000) == pytest.approx(0, abs=0.4)
    x = np.zeros(2000, "<i2")
    x[[10, 10 + 397, 10 + 397 + 441, 10 + 397 + 441 + 485]] = 32767
    assert [(f, n) for f, _, n in S.clip_events(x)] == [(10, 3), (1333, 1)]


def test_loops_and_noise():
    rng = np.random.default_rng(1)
    body = np.cumsum(rng.standard_normal(5000)) * 60
    body -= np.linspace(body[0], body[-1], 5000)
    intro = rng.standard_normal(3000) * 3000
    found = S.loop_of(np.clip(np.concatenate([intro, *[body] * 6]), -32000, 32000).astype("<i2"))
    assert found["period"] == pytest.approx(5000, abs=0.05) and found["intro"] <= 3000 + 5000 // 4
    assert S.loop_of((rng.standard_normal(30000) * 3000).astype("<i2")) == {}


def test_twins_mix_and_lag():
    rng = np.random.default_rng(2)
    x = np.convolve(rng.standard_normal(6000), np.hanning(32), "same") * 900
    assert S.aligned_residual(x.astype("<i2"), np.roll(x, 2).astype("<i2")) < -50
    assert S.aligned_residual(x.astype("<i2"), (rng.standard_normal(6000) * 900).astype("<i2")) > -10
    m, c = rng.standard_normal(4000), rng.standard_normal(4000)
    got = S.mix_gains(0.5 * m + 0.8 * c, m, c, 1000)
    assert np.allclose(got[:, :2], [0.5, 0.8]) and np.allclose(got[:, 2], 0, atol=1e-9)
    assert S.best_lag(m, np.roll(m, -7), 20) == 7


def test_adpcm_follows_a_coder():
    x = (np.sin(np.arange(2000) / 30) * 9000).astype(int)
    value, index, codes, table = 0, 0, [], S.steps()
    for want in x:
        step, delta = table[index], want - value
        code, left = (8 if delta < 0 else 0), abs(delta)
        for bit, part in ((4, step), (2, step >> 1), (1, step >> 2)):
            if left >= part:
                code, left = code | bit, left - part
        move = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - move if code & 8 else value + move))
        index = max(0, min(88, index + int(S.INDEX[code])))
        codes.append(code)
    out = S.ima_decode(bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2])))
    assert np.abs(out[100:].astype(int) - x[100:]).mean() < 150 and len(out) == 2000


def test_archives(spark, tmp_path):
    (tmp_path / "z").mkdir(), (tmp_path / "loose").mkdir()
    with zipfile.ZipFile(tmp_path / "z/a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/one.bin", b"hello" * 10), z.writestr("two.bin", b"")
    (tmp_path / "z/bad.zip").write_bytes(b"no archive")
    (tmp_path / "loose/x.bin").write_bytes(b"hello")
    pcm = tone(0.5, 0.01).tobytes()
    fmt = struct.pack("<HHIIHH", 1, 1, 44100, 88200, 2, 16)
    (tmp_path / "loose/s.wav").write_bytes(b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm)
    zips = archives.files(spark, str(tmp_path), "*.zip")
    got = archives.zip_members(zips, inflate=True).orderBy("path", "ord").collect()
    assert [(r["ord"], r["member_path"], r["size"], r["content"] and bytes(r["content"])) for r in got[:2]] == [(0, "d/one.bin", 50, b"hello" * 10), (1, "two.bin", 0, b"")]
    assert got[2]["error"] and got[2]["ord"] is None
    loose = archives.files(spark, str(tmp_path / "loose"))
    assert [r["member_path"] for r in archives.folder_members(loose).orderBy("ord").collect()] == ["s.wav", "x.bin"]
    kinds = {(r["stem"], r["kind"]) for r in archives.units(archives.files(spark, str(tmp_path), content=False)).collect()}
    assert kinds == {("a", "zip"), ("bad", "zip"), ("loose", "folder")}
    sounds = {r["path"].rsplit("/")[-1]: r for r in archives.wav_sounds(loose).collect()}
    assert bytes(sounds["s.wav"]["pcm"]) == pcm and sounds["s.wav"]["rate"] == 44100 and sounds["x.bin"]["error"]


def test_texts(spark, tmp_path):
    (tmp_path / "n.csv").write_bytes('﻿# rom: abc\r\nNAME,Id,other\r\n"a, ""b""\nc",0x10,x\r\n\r\nlast,11\r\n'.encode())
    got = texts.commented_csv(spark, str(tmp_path / "n.csv"), ["id", "name", "none"]).orderBy("line").collect()
    assert [(r["line"], r["id"], r["name"], r["none"], r["meta"]) for r in got] == [(3, "0x10", 'a, "b"\nc', None, {"rom": "abc"}), (6, "11", "last", None, {"rom": "abc"})]
    (tmp_path / "d.txt").write_text("; comment\nfirst game\n:0A:one\n:0b:two\n:0a:three\n\nother\n:01:x\n")
    found = texts.dictionary(texts.lines(spark, str(tmp_path / "d.txt")))
    assert [tuple(r)[1:] for r in found.orderBy("ord").collect()] == [("first game", 3, "0a", "three"), ("first game", 4, "0b", "two"), ("other", 8, "01", "x")]
    back = sinks.dictionary_lines(found).orderBy("ord").collect()
    assert [r["value"] for r in back][:3] == ["first game", ":0a:three", ":0b:two"]
    (tmp_path / "o.csv").write_text("id,fname,gain\n1,a.wav,200\n1,b.wav,\n2,../x.wav,5\nzz,c.wav,1\n")
    assert [tuple(r) for r in texts.overrides(spark, str(tmp_path / "o.csv")).collect()] == [(1, "b.wav", 100.0, 3)]
    (tmp_path / "m.md").write_text("| a | b |\n|---|:-:|\n| x | 1 |\n| x | 2 |\n| y |\n")
    assert [r["cells"] for r in texts.markdown_rows(texts.lines(spark, str(tmp_path / "m.md")), 2).orderBy("line").collect()] == [["a", "b"], ["x", "1"]]


def test_reports_and_settings(spark, tmp_path):
    for folder, text in (("one/s1", '{"rom": "old"}'), ("two/s1", '{"rom": "new"}'), ("two/s2", "no json")):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "report.json").write_text(text)
    got = texts.latest_reports(spark, [str(tmp_path / "one"), str(tmp_path / "two")], "report.json", "rom string, lufs double")
    assert [(r["set"], r["report"] and r["report"]["rom"], r["bad"]) for r in got.orderBy("set").collect()] == [("s1", "new", False), ("s2", None, True)]
    schema = "section string, key string, value string, ord int"
    merged = sinks.merged_settings(spark.createDataFrame([("a", "x", "1", 0), ("a", "y", "2", 1)], schema), spark.createDataFrame([("a", "x", "9", 0), ("a", "y", "9", 1), ("b", "z", "3", 2)], schema), [("a", "y")])
    assert [tuple(r)[:3] for r in merged.orderBy("ord").collect()] == [("a", "x", "1"), ("a", "y", "9"), ("b", "z", "3")]
    lines = spark.createDataFrame([("p", 1, -1, 100, 90, True, 0, 'a "b"', "f.wav")], "pack string, id int, channel int, duck int, gain int, loop boolean, stop int, name string, fname string")
    assert sinks.pack_lines(lines).first()["value"] == '0x0001,,100,90,100,0,"a b","f.wav"'
    sinks.write_lines(sinks.pack_lines(lines), str(tmp_path / "out"), "pack", ["id"], "\r\n")
    assert next((tmp_path / "out/pack=p").glob("part-*")).read_bytes().endswith(b'"f.wav"\r\n')


def test_adpcm_streams_together_as_one_by_one():
    rng = np.random.default_rng(5)
    streams = [rng.integers(0, 256, n, np.uint8).tobytes() for n in [*rng.integers(0, 90, 60).tolist(), 3000, 0, 1]]
    for got, one_stream in zip(S.ima_decode_all(streams), streams):
        assert np.array_equal(got, S.ima_decode(one_stream))
