"""Sound files written and read again; gains with dither against a plain loop."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import gains
from corvane.sources import archives, wave

SCHEMA = "name string, rate int, channels int, pcm binary, loop_start long, loop_end long, extra int"


def tone(n, seed=0):
    return np.random.default_rng(seed).integers(-20000, 20000, n).astype("<i2")


def files(folder):
    return {f: (folder / f).read_bytes() for f in os.listdir(folder)}


def test_files_are_read_as_written_and_a_second_write_changes_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = [(f"s{i}.wav", 22_050, 1, bytearray(tone(100 + i, i).tobytes()), i * 2 if i % 2 else None, 50 + i if i % 2 else None, i) for i in range(20)]
    rows += [("two.wav", 44_100, 2, bytearray(tone(40).tobytes()), None, None, 0), (None, 1, 1, bytearray(b"ab"), None, None, 0), ("none.wav", 1, 1, None, None, None, 0), ("odd.wav", None, None, bytearray(b"\1\2\3\4"), 0, 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    wave.write_waves(df, str(folder))
    first, times = files(folder), {f: os.stat(folder / f).st_mtime_ns for f in os.listdir(folder)}
    assert len(first) == 22 and not [f for f in first if f.startswith(".")]
    wave.write_waves(df.repartition(3), f"file://{folder}")
    assert files(folder) == first and times == {f: os.stat(folder / f).st_mtime_ns for f in os.listdir(folder)}
    found = archives.files(spark, str(folder))
    got = {os.path.basename(r["path"]): r for r in archives.wav_sounds(found).collect()}
    points = {os.path.basename(r["path"]): (r["loop_start"], r["loop_end"]) for r in wave.loops(found).collect()}
    for name, rate, channels, pcm, start, end, _ in rows:
        if name and pcm is not None:
            r = got[name]
            assert (r["rate"], r["channels"], r["bits"], r["error"]) == (rate or 44_100, channels or 1, 16, None)
            assert channels == 2 or bytes(r["pcm"]) == bytes(pcm)
            assert points[name] == (start, end)


def test_a_job_that_fails_leaves_nothing(spark, tmp_path):
    folder = tmp_path / "out"
    rows = [(f"s{i}.wav", 8000, 1, bytearray(b"1234"), None, None, 0) for i in range(10)]
    wave.write_waves(spark.createDataFrame(rows[:2], SCHEMA), str(folder))
    before = files(folder)
    for bad in ([("../x.wav", 8000, 1, bytearray(b"12"), None, None, 0)], [("s5.wav", 8000, 1, bytearray(b"9999"), None, None, 0)]):
        with pytest.raises(Exception, match="not a plain file name|one file name"):
            wave.write_waves(spark.createDataFrame(rows[2:] + bad, SCHEMA).repartition(4), str(folder))
        assert files(folder) == before
    with pytest.raises(Exception, match="need"):
        wave.write_waves(spark.range(1), str(folder))


def test_a_loop_chunk_is_replaced_and_the_others_stay():
    plain = wave.wave_bytes(tone(31).tobytes() + b"", 8000)
    odd = plain[:36] + b"note\x03\0\0\0abc\0" + plain[36:]
    odd = odd[:4] + (len(odd) - 8).to_bytes(4, "little") + odd[8:]
    once = wave.with_loop(odd, 3, 9)
    assert wave.loop_points(once) == (3, 9) and wave.with_loop(once, 3, 9) == once
    assert wave.loop_points(wave.with_loop(once, 1, 2)) == (1, 2) and len(wave.with_loop(once, 1, 2)) == len(once)
    assert [n for n, _ in wave.chunks(once)] == [b"fmt ", b"note", b"data", b"smpl"] and int.from_bytes(once[4:8], "little") == len(once) - 8
    assert wave.loop_points(plain) is None
    for bad in (b"", b"RIFF1234WAV", once[:-1], b"RIFF\0\0\0\0WAVEdata\0\0\0\0"):
        with pytest.raises(ValueError):
            wave.with_loop(bad, 0, 1)


def test_extension_and_cut(spark):
    x = np.arange(20, dtype="<i2")
    two = np.arange(40, dtype="<i2")
    rows = [(1, bytearray(x.tobytes()), 1, 5, 10, 100), (2, bytearray(two.tobytes()), 2, 4, 3, 11), (3, bytearray(x.tobytes()), 1, 15, 10, 100), (4, bytearray(x.tobytes()), 1, None, None, 100), (5, None, 1, 1, 1, 9), (6, bytearray(x.tobytes()), 1, 5, 10, 3)]
    df = spark.createDataFrame(rows, "i int, pcm binary, channels int, intro long, period long, target int")
    got = {r["i"]: r for r in wave.extended(df, F.col("target")).collect()}
    of = lambda r: np.frombuffer(bytes(r["pcm"]), "<i2").tolist()
    assert of(got[1]) == x[:5].tolist() + x[5:15].tolist() * 10 and (got[1]["cycles"], got[1]["loop_start"], got[1]["loop_end"]) == (10, 5, 14)
    assert of(got[2]) == two[:8].tolist() + two[8:14].tolist() * 3
    assert of(got[3]) == of(got[4]) == x.tolist() and got[3]["cycles"] is got[4]["loop_end"] is None and got[5]["pcm"] is None
    assert of(got[6]) == x[:15].tolist() and got[6]["cycles"] == 1
    cut = {r["i"]: r for r in wave.body_cut(df).collect()}
    assert of(cut[1]) == x[5:15].tolist() and of(cut[2]) == two[8:14].tolist() and of(cut[3]) == x.tolist()


def plain_scale(samples, gain, name):
    h = gains.FNV_START
    for b in name.encode():
        h = ((h ^ b) * gains.FNV_FACTOR) % 2**64
    a, b = list(gains.FIRST), list(gains.SECOND)
    a[0] ^= h % 2**32
    a[3] ^= h >> 32
    b[0] ^= (h >> 16) % 2**32
    b[3] ^= h % 2**32

    def following(s):
        t = s[0] ^ (s[0] << 11) % 2**32
        s[:] = [s[1], s[2], s[3], s[3] ^ (s[3] >> 19) ^ t ^ (t >> 8)]
        return (s[3] >> 9) / 2**23

    out, clamped = [], 0
    for x in samples.tolist():
        v = x * gain + (following(a) - following(b))
        v = int(abs(v) + 0.5) * (1 if v >= 0 else -1)
        clamped += not -32768 <= v <= 32767
        out.append(max(-32768, min(32767, v)))
    return out, clamped


@pytest.mark.parametrize("n", [0, 1, 2, 511, 512, 513, 5000])
def test_gains_with_dither_equal_a_plain_loop(n):
    samples = tone(n, n)
    for name, gain in (("0x0186.wav", 0.7), ("", 2.5), ("é", 0.0)):
        y, clamped = gains.scale(samples, gain, name)
        assert (y.tolist(), clamped) == plain_scale(samples, gain, name)
    assert n < 9 or (gains.scale(samples, 0.0, "a")[0] != gains.scale(samples, 0.0, "b")[0]).any()


def test_scaled_rows(spark):
    x = bytearray(tone(300).tobytes())
    rows = [("a", x, 1.0, 1), ("b", x, 1.0, 2), ("c", x, 9.0, 3), (None, x, 1.0, 4), ("d", None, 1.0, 5), ("e", x, None, 6), ("f", bytearray(b""), 1.0, 7)]
    df = spark.createDataFrame(rows, "name string, pcm binary, gain double, clamped int")
    one, two = ({r["name"]: r for r in gains.scaled(d).collect()} for d in (df, df.repartition(5)))
    assert one == two and one["a"]["pcm"] != one["b"]["pcm"] and one["c"]["clamped"] > 100
    assert one[None]["pcm"] is one["d"]["pcm"] is one["e"]["pcm"] is None and one["f"]["pcm"] == b"" and one["f"]["clamped"] == 0
