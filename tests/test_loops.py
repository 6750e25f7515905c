"""Refined loops against planted ones."""

import math

import numpy as np
import pytest

from corvane.operators import loops

RATE = 44_100


def cycle(t, length):
    """Whole harmonics of the cycle under an amplitude that repeats with it."""
    phase = 2 * math.pi * t / length
    k = [round(hz * length / RATE) for hz in (220, 330, 1250)]
    half = 0.5 - 0.5 * np.cos(phase)
    return (0.55 + 0.45 * np.sin(3 * phase)) * (8000 * np.sin(k[0] * phase) + 3000 * half * np.sin(k[1] * phase) + 1000 * np.sin(k[2] * phase))


def planted(intro, period, total, seed):
    rng = np.random.default_rng(seed)
    n = np.arange(total)
    first = 6000 * np.sin(n * n * 1e-9) + 2000 * (rng.random(total) - 0.5)
    x = np.where(n < intro, first, cycle((n - intro) % period, period))
    return np.round(x + rng.random(total) - rng.random(total)).astype("<i2")


@pytest.mark.parametrize("period", [4.0 * RATE, 338.688 * 600, 2.3 * RATE + 0.37, 130_000.5])
def test_periods_with_fractions_are_found(period):
    intro = RATE
    x = planted(intro, period, intro + int(7 * period) + 21 * RATE * (period < 4 * RATE), 1)
    got = loops.loop_of(x)
    assert abs(got["exact"] / got["cycles"] - period) < 0.01 and got["residual_db"] < -30
    assert intro <= got["intro"] < intro + loops.WINDOW + RATE and abs(got["repeats_from"] - intro) <= loops.WINDOW
    assert got["error"] < 60 and abs(got["exact"] - got["period"]) <= (0.05 if got["cycles"] > 1 else 0.5)
    hinted = loops.loop_of(x, hint=period)
    assert hinted["matched"] == pytest.approx(got["matched"], abs=loops.WINDOW)


def test_what_does_not_repeat_has_no_loop():
    rng = np.random.default_rng(2)
    assert loops.loop_of(rng.integers(-9000, 9000, 50 * RATE).astype("<i2")) == {}
    assert loops.loop_of(np.zeros(0, "<i2")) == loops.loop_of(np.ones(100, "<i2")) == {}
    assert loops.loop_of(planted(RATE, 15.0 * RATE, 30 * RATE, 3)) == {}


def test_a_phrase_inside_a_longer_loop_is_not_the_loop():
    rng = np.random.default_rng(4)
    a, b = (np.round(cycle(np.arange(3 * RATE), 3.0 * RATE) * g + rng.normal(0, 300, 3 * RATE)) for g in (1.0, 0.4))
    whole = np.concatenate([a, a, b, b[::-1]])
    got = loops.loop_of(np.concatenate([whole] * 4).astype("<i2"))
    assert got["period"] == len(whole) and got["intro"] == 0


def test_the_fraction_of_a_lag():
    n = np.arange(60_000)
    for fraction in (-0.8, -0.31, 0.0, 0.137, 0.5):
        period = 20_000 + fraction
        y = sum(np.sin(2 * math.pi * round(f * period / RATE) / period * n) * 3000 for f in (313.0, 1777.0))
        assert abs(loops.fraction_of(y, 1000, 20_000, 20_000) - fraction) < 0.01
        assert abs(loops.whole_lag(y, RATE, 20_040, 100) - period) <= 0.8


def test_taps_of_a_whole_sample():
    taps = loops.delay_taps(0.0)
    assert abs(taps[loops.HALF] - 1) < 1e-12 and np.abs(np.delete(taps, loops.HALF)).max() < 1e-12
    assert loops.delay_taps(1.0)[loops.HALF + 1] == pytest.approx(1.0, abs=0.02)


def test_whole_cycles():
    assert loops.whole_cycles(2984.1, 0, 10 * RATE, RATE) == (29841, pytest.approx(29841.0), 10)
    assert loops.whole_cycles(1000.02, 0, RATE, RATE)[2] == 1
    assert loops.whole_cycles(80_000.3, 0, 10 * RATE, RATE)[2] == 1
    assert loops.whole_cycles(2984.1, 0, 20_000, RATE)[2] == 1


def test_the_seam_of_a_click_and_of_a_clean_loop():
    period = 200
    wave = np.round(1000 * np.sin(2 * math.pi * np.arange(3 * period) / period)).astype("<i2")
    clean = loops.seam(wave, 50, period)
    assert clean["error"] == 0 and clean["joint"] == clean["natural"] <= clean["largest"]
    click = loops.seam(wave, 50, period - 30)
    assert click["error"] > 400 and click["joint"] > 10 * click["p99"]
    two = np.stack([wave, np.roll(wave, 25)], 1)
    assert loops.seam(two, 50, period)["error"] == 0 and loops.seam(two[:250], 50, period)["natural"] == max(abs(int(v)) for v in two[249])


def test_rows(spark):
    x = planted(RATE // 2, 1.5 * RATE, 30 * RATE, 5)
    df = spark.createDataFrame([(1, bytearray(x.tobytes())), (2, None), (3, bytearray(b"")), (4, bytearray(x[:RATE].tobytes()))], "i long, pcm binary")
    got = {r["i"]: r for r in loops.refined_loops(df).collect()}
    assert got[1]["period"] == int(1.5 * RATE) and got[1]["cycles"] == 1 and len(got) == 4
    assert all(got[i]["period"] is None for i in (2, 3, 4))
