"""Series as rows against plain walks over whole signals."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import series, spans


def frame(spark, sounds, names="v"):
    rows = [(k, i, *([x] if isinstance(x, (int, float)) else list(x))) for k, xs in sounds.items() for i, x in enumerate(xs)]
    kind = "double" if any(isinstance(x, float) for r in rows for x in r) else "int"
    return spark.createDataFrame(rows, "k string, i long, " + ", ".join(f"{n} {kind}" for n in names))


def plain_held(s, gap, hold, burst, silence=2, span=16, deviation=1.0):
    end = len(s)
    differ = lambda a, b: any(abs(x - y) > 2 * silence for x, y in zip(a, b))

    def flat(a, b):
        for c in range(len(s[0])):
            own = [f[c] for f in s[a:b]]
            if max(own) - min(own) > span or np.std(own) > deviation:
                return False
        return True

    bursts = []
    for i in range(1, end):
        if differ(s[i], s[i - 1]):
            if bursts and i - bursts[-1][1] <= gap:
                bursts[-1][1] = i
            else:
                bursts.append([i, i])
    cut = end
    for k in range(len(bursts) - 1, 0, -1):
        (start, last), before = bursts[k], bursts[k - 1][1]
        if not (last - start <= burst and start - before > hold and flat(before, start) and differ(s[start - 1], s[min(last + 1, end - 1)])):
            break
        cut = before
    return cut


def held_sound(r, channels):
    out, level = [[r.randrange(-900, 900) for _ in range(channels)] for _ in range(r.randrange(1, 30))], [r.randrange(-50, 50) for _ in range(channels)]
    for _ in range(r.randrange(0, 6)):
        for _ in range(r.choice([3, 12, 25, 40])):
            out.append([x + r.choice([0, 0, 0, 1, -1]) * r.choice([1, 1, 1, 4]) for x in level])
        click = r.random() < 0.3
        before = list(level)
        level = [x + r.choice([0, 5, -60, 200]) for x in level]
        for _ in range(r.choice([0, 1, 3, 8])):
            out.append([r.randrange(-900, 900) for _ in range(channels)])
        if click:
            level = before
    return out


@pytest.mark.parametrize("channels,most", [(1, None), (2, None), (2, 5)])
def test_held_ends(spark, monkeypatch, channels, most):
    if most:
        monkeypatch.setattr(spans, "ROWS_OF_A_KEY", most)
    sounds = {str(i): held_sound(random.Random(i), channels) for i in range(120)}
    sounds["steps"] = [[500] * channels] * 3 + [[0] * channels] * 30 + [[100] * channels] * 30 + [[40] * channels] * 30
    sounds["click"] = [[500] * channels] * 3 + [[0] * channels] * 30 + [[100] * channels] + [[0] * channels] * 30
    sounds["one"] = [[3] * channels]
    names = "xy"[:channels]
    got = {r["k"]: r["cut"] for r in series.held_end(frame(spark, sounds, names), ["k"], "i", list(names), 3, 10, 4).collect()}
    want = {k: plain_held(s, 3, 10, 4) for k, s in sounds.items()}
    assert got == want
    assert got["steps"] == 3 and got["click"] == 64 and sum(want[k] < len(s) for k, s in sounds.items()) > 3


def test_a_burst_that_is_too_long_or_a_level_that_moves_is_no_step(spark):
    calm = [[1]] * 20
    sounds = {
        "step": [[90]] + calm + [[50]] * 20,
        "long": [[90]] + calm + [[x] for x in (300, -200, 100, 400, -100, 200, 50)] + [[50]] * 20,
        "drift": [[90]] + [[i] for i in range(20)] + [[80]] * 20,
        "short": [[90]] + [[1]] * 4 + [[50]] * 20,
    }
    got = {r["k"]: r["cut"] for r in series.held_end(frame(spark, sounds, "x"), ["k"], "i", ["x"], 3, 10, 4).collect()}
    assert got == {"step": 1, "long": 48, "drift": 41, "short": 25}


def plain_lags(env, least, most, confirm, limit=0.2, candidates=16):
    k, diffs = len(env), []
    for m in range(least, min(most, k - 1) + 1):
        start = k - m - max(m, confirm)
        if start < 0:
            break
        num = sum(abs(env[i] - env[i + m]) for i in range(start, k - m))
        diffs.append((m, num / (1e-9 + sum(env[i] + env[i + m] for i in range(start, k - m)))))
    if not diffs:
        return []
    best = min(d for _, d in diffs)
    bound = min(limit, max(3 * best, best + 0.01))
    out = [m for i, (m, d) in enumerate(diffs) if d <= bound and (i == 0 or diffs[i - 1][1] > d) and (i + 1 == len(diffs) or diffs[i + 1][1] >= d)]
    return out[:candidates]


@pytest.mark.parametrize("block", [7, 4096])
def test_lags_of_repeating_levels(spark, block):
    r = random.Random(4)
    sounds = {f"p{p}": [r.randrange(100) for _ in range(9)] + [r.randrange(50, 200) for _ in range(p)] * 4 for p in (3, 5, 8, 13)}
    sounds |= {"noise": [r.randrange(100) for _ in range(60)], "flat": [7] * 40, "silent": [0] * 30, "short": [5], "slow": [100 + int(40 * math.sin(i / 3)) for i in range(80)]}
    found = defaultdict(list)
    for x in series.repeat_lags(frame(spark, sounds), ["k"], "i", "v", most=20, least=2, confirm=6, block=block).orderBy("rank").collect():
        found[x["k"]].append(x["lag"])
    assert {k: found.get(k, []) for k in sounds} == {k: plain_lags(v, 2, 20, 6) for k, v in sounds.items()}
    assert all(p in found[f"p{p}"] for p in (3, 5, 8, 13))


def test_the_loudest_window(spark):
    r = random.Random(5)
    sounds = {str(n): [r.randrange(-9, 9) for _ in range(n)] for n in (1, 7, 8, 9, 20, 57, 100, 333)} | {"even": [3] * 90, "late": [1] * 50 + [9] * 3 + [1] * 40}
    for length, last, spare in ((8, 40, 0), (7, 30, 5), (1, 10, 0)):
        want = {}
        for k, x in sounds.items():
            end = len(x) - spare - length
            if end >= 0:
                places = [*range(max(0, end - last), end + 1, max(1, length // 2)), end]
                want[k] = max((sum(v * v for v in x[a : a + length]), a) for a in places)[::-1]
        got = {x["k"]: (x["begin"], x["energy"]) for x in series.loudest_window(frame(spark, sounds), ["k"], "i", "v", length, last, spare).collect()}
        assert got == want


def test_gains_of_a_mix_by_windows(spark):
    rng = np.random.default_rng(6)
    width, music, other = 200, rng.normal(0, 3000, 2000), np.concatenate([np.zeros(800), rng.normal(0, 2000, 1200)])
    gains = np.repeat([1, 1, 1, 1, 0.5, 0.25, 0.25, 0.5, 1, 1], width)
    mix = gains * music + 0.7 * other + rng.normal(0, 2, 2000)
    rows = frame(spark, {"a": [tuple(map(float, x)) for x in zip(mix, music, other)] + [(1.0, 1.0, 1.0)] * 5}, ["mix", "music", "other"])
    got = series.mix_gains(rows, ["k"], "i", "mix", "music", "other", width).orderBy("window").collect()
    assert len(got) == 10
    for x, g in zip(got, gains[::width]):
        assert abs(x["music_db"] - 20 * math.log10(g)) < 0.1 and x["residual_db"] < -50
        assert x["other_db"] is None if x["window"] < 4 else abs(x["other_db"] - 20 * math.log10(0.7)) < 0.1


def test_the_lag_between_two_series(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-999, 999, 700).tolist()
    sounds, want = {"left": {}, "right": {}}, {}
    for lag in (-40, -7, 0, 1, 23, 40):
        k = str(lag)
        sounds["left"][k], sounds["right"][k] = x[100:500], x[100 - lag : 600 - lag]
        want[k] = lag
    left, right = (frame(spark, sounds[s]) for s in ("left", "right"))
    got = {r["k"]: r["lag"] for r in series.best_lag(left, right, ["k"], "i", "v", 40, 300).collect()}
    assert got == want


def test_idle_levels_of_chunks(spark):
    rows = [("a", 0, 5, 90), ("a", 1, 2055, 2057), ("a", 2, -40, 4000), ("a", 3, -7, -4), ("b", 0, 0, 4)]
    got = series.idle_levels(spark.createDataFrame(rows, "k string, o long, low int, high int"), ["k"], "o", "low", "high", 2).collect()
    assert sorted((r["k"], r["o"], r["idle"]) for r in got) == [("a", 0, 0), ("a", 1, 2056), ("a", 2, 2056), ("a", 3, -5), ("b", 0, 2)]


def test_empty_series(spark):
    none = spark.createDataFrame([], "k string, i long, v int")
    assert series.held_end(none, ["k"], "i", ["v"], 3, 10, 4).count() == 0
    assert series.repeat_lags(none, ["k"], "i", "v", 5).count() == 0
    assert series.loudest_window(none, ["k"], "i", "v", 4, 10).count() == 0
    assert series.best_lag(none, none, ["k"], "i", "v", 4, 10).count() == 0
    assert series.mix_gains(none.withColumn("w", F.col("v")), ["k"], "i", "v", "w", "v", 4).count() == 0
