"""Sounds of one level that are no twins are ruled out by their marks, and no twin is."""

import math

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import matching as M
from corvane.operators import signals as S


def shifted(x, by):
    """A periodic sound, delayed by `by` samples."""
    f = np.fft.rfft(x)
    return np.fft.irfft(f * np.exp(-2j * np.pi * np.arange(len(f)) / len(x) * by), len(x))


def whole(x):
    return np.clip(np.round(x), -32768, 32767).astype("<i2")


def smooth(r, n, width=9):
    x = np.fft.irfft(np.fft.rfft(r.normal(0, 1, n)) * np.exp(-((np.arange(n // 2 + 1) / (n / width)) ** 2)), n)
    return x / np.abs(x).max()


def test_unlike_sounds_of_one_level_are_not_compared(spark, monkeypatch):
    r = np.random.default_rng(3)
    fading = [9000 * smooth(r, 3000) * np.hanning(3000) for _ in range(40)]
    level = [math.sqrt(S.block_energies(S.dc_blocked(x)).max()) for x in fading]
    fading = [x * level[0] / own for x, own in zip(fading, level)]
    made = [*map(whole, fading), whole(shifted(fading[0], 1.4))[:2999], whole(shifted(fading[10], -2.7))]
    sounds = spark.createDataFrame([(0, i, x.tobytes()) for i, x in enumerate(made)], "k int, sound long, pcm binary")
    seen, band = [], M.band
    monkeypatch.setattr(M, "band", lambda *a: seen.append(band(*a)) or seen[-1])
    rows = lambda: sorted(tuple(x) for x in S.find_twins(sounds, ["k"]).collect())
    assert rows() == [(0, 40, 0), (0, 41, 10)] and seen.pop().count() == 2
    # All pairs of about that level are compared if no marks are asked, and give the same.
    monkeypatch.setattr(S, "may_be_twins", lambda a, b: F.lit(True))
    assert rows() == [(0, 40, 0), (0, 41, 10)] and seen.pop().count() > 200


def test_marks_of_twins_near_the_limit_are_within_bounds():
    r, near = np.random.default_rng(4), 0
    for i in range(400):
        n = int(r.integers(55, 1500))
        x = r.uniform(200, 20000) * smooth(r, n + 200, r.uniform(4, 40)) + r.uniform(-3000, 3000)
        y = shifted(x, r.uniform(-3.9, 3.9))[100 : 100 + n]
        left = np.sqrt((y**2).mean()) * 10 ** (-r.uniform(59, 66) / 20)
        # What is left lies in one mark, or everywhere, or is a louder copy.
        y = [y + left * np.sqrt(2) * np.cos(np.arange(n) * r.choice(S.MARKS) + r.uniform(0, 6)), y + r.normal(0, left, n), y * 1.00095][i % 3]
        a, b = whole(y), whole(x[100 : 100 + n + int(r.integers(-1, 2))])
        if S.aligned_residual(a, b) <= -60:
            near, n, k = near + 1, min(len(a), len(b)), len(S.MARKS)
            point, bounds = np.array(S.marks(a, n, -60.0)[:k]), np.array(S.marks(b, n, -60.0))
            assert (point >= bounds[k : 2 * k]).all() and (point <= bounds[2 * k :]).all()
    assert near > 100


def test_too_few_samples_have_no_marks(monkeypatch):
    x = np.arange(60, dtype="<i2")
    assert S.marks(x, 54, -60.0) is None and len(S.marks(x, 55, -60.0)) == 3 * len(S.MARKS)
    x = whole(5000 * smooth(np.random.default_rng(5), 900))
    one = S.marks(x, 900, -60.0)
    monkeypatch.setattr(S, "MARKED", 100)
    assert np.allclose(S.marks(x, 900, -60.0), one)
