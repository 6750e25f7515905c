"""Loops of sampled sounds, refined: coarse lags of the level, the best whole lag on a decimated signal, the fraction of a
sample by a delay kernel, the stretch that repeats, whole cycles, and how the seam sounds. A row is a whole sound."""

from __future__ import annotations

import math

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame

from corvane.operators.signals import RATE, per_sound

#: Samples of a level block and between two; of a verified window and of the steps that end the walk; decimation.
BLOCK, HOP, WINDOW, STEP, DECIMATED = 4096, 1024, 2048, 64, 8
#: Half the taps of the delay kernel; tolerances in LSB and as a share of the signal; the quick look's limit in dB.
HALF, LSB, SHARE, QUICK = 16, 4.0, 0.0316, -6.0
#: Seconds of the shortest period, of the span that confirms one, and of the longest body of several cycles.
SHORTEST, CONFIRM, LONGEST_BODY = 0.05, 20.0, 2.0
#: How far from a whole sample a body of several cycles may be.
WHOLE = 0.05


def coarse_lags(x: np.ndarray, rate: int, confirm: int, limit: float = 0.2, candidates: int = 16) -> list[int]:
    """Lags in hops at which the levels of the end look like those before: the local minima of the relative difference
    that are nearly as good as the best, the shortest `candidates` of them."""
    hops = (x[: len(x) // HOP * HOP].astype(float).reshape(-1, HOP) ** 2).sum(1)
    if len(hops) < BLOCK // HOP:
        return []
    level = np.sqrt(np.convolve(hops, np.ones(BLOCK // HOP), "valid") / BLOCK)
    k, span, first = len(level), -(-confirm // HOP), max(1, -(-int(SHORTEST * rate) // HOP))
    lags = [m for m in range(first, k) if m + max(m, span) <= k]
    if not lags:
        return []
    diff = np.empty(len(lags))
    for i, m in enumerate(lags):
        a, b = level[k - m - max(m, span) : k - m], level[k - max(m, span) :]
        diff[i] = np.abs(a - b).sum() / ((a + b).sum() + 1e-9)
    bound = min(limit, max(3 * diff.min(), diff.min() + 0.01))
    dip = (np.concatenate([[np.inf], diff[:-1]]) > diff) & (np.concatenate([diff[1:], [np.inf]]) >= diff) & (diff <= bound)
    return [lags[i] for i in np.flatnonzero(dip)[:candidates]]


def whole_lag(x: np.ndarray, rate: int, lag: int, radius: int) -> int | None:
    """The lag within `radius` of `lag` at which the end follows best: squared differences of the decimated signal first,
    then of all samples around its best."""
    high, low = lag + radius, max(1, lag - radius)
    width = min(len(x) - high, 2 * rate)
    if width < WINDOW:
        return None
    begin = len(x) - high - width
    small = x[: len(x) // DECIMATED * DECIMATED].reshape(-1, DECIMATED).mean(1)

    def best(signal: np.ndarray, at: int, n: int, lags: range) -> int | None:
        lags = range(lags.start, min(lags.stop, len(signal) - at - n + 1))
        if not len(lags):
            return None
        shifted = sliding_window_view(signal[at + lags.start : at + lags.stop - 1 + n], n)
        return lags[int(np.argmin(((shifted - signal[at : at + n]) ** 2).sum(1)))]

    rough = best(small, begin // DECIMATED, width // DECIMATED, range(low // DECIMATED, high // DECIMATED + 1))
    if rough is None:
        return None
    near = rough * DECIMATED
    return best(x, begin, width, range(max(low, near - 12), min(high, near + 12) + 1))


def delay_taps(fraction: float) -> np.ndarray:
    """Taps that read a signal `fraction` of a sample later: a sinc under a Blackman window."""
    t = np.arange(-HALF, HALF + 1) - fraction
    turn = math.pi * (t / (HALF + 2) + 1)
    return np.sinc(t) * (0.42 - 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn))


def fraction_of(x: np.ndarray, at: int, n: int, lag: int) -> float:
    """The fraction of a sample, within one either way, by which the signal comes later than `lag`: the best of a grid,
    then the vertex of a parabola through the squared residuals around it."""
    grid = np.arange(-20, 21) * 0.05
    seen = sliding_window_view(x[at + lag - HALF : at + lag + n + HALF], 2 * HALF + 1) @ np.stack([delay_taps(d) for d in grid], 1)
    left = ((x[at : at + n, None] - seen) ** 2).mean(0)
    i = int(np.argmin(left))
    if i in (0, len(grid) - 1):
        return float(grid[i])
    bend = left[i - 1] - 2 * left[i] + left[i + 1]
    return float(grid[i] + 0.05 * np.clip(0.5 * (left[i - 1] - left[i + 1]) / bend if bend > 0 else 0.0, -1, 1))


def verified(x: np.ndarray, lag: int, fraction: float, need: int) -> dict | None:
    """Where the signal begins to repeat `lag` + `fraction` samples later up to its end, if over `need` samples and a
    period: windows are walked back while what is left of them is small, then small steps. The body begins in the next
    period, a second of it at most, where the two cycles differ least."""
    last = len(x) - lag - HALF - 2
    if lag <= HALF or last <= 0:
        return None
    later = np.correlate(x[lag - HALF :], delay_taps(fraction), "valid")
    n = min(last, len(later))
    error, square = (np.concatenate([[0.0], np.cumsum(v**2)]) for v in (x[:n] - later[:n], x[:n]))

    def rms(total: np.ndarray, a: int, b: int) -> float:
        return math.sqrt(max(total[b] - total[a], 0.0) / (b - a))

    start, worst, any_ = n, -math.inf, -math.inf
    for size in (WINDOW, STEP):
        while start >= (size if size == WINDOW else 1):
            a = max(0, start - size)
            left, signal = rms(error, a, start), rms(square, a, start)
            if left > LSB and left > SHARE * signal:
                break
            if size == WINDOW and signal > 0:
                level = 20 * math.log10(max(left, 1e-9) / signal)
                any_ = max(any_, level)
                worst = max(worst, level) if signal > 10 * LSB else worst
            start = a
    if n - start < max(lag, need):
        return None
    found = {"intro": 0, "repeats_from": start, "period": lag, "exact": lag + fraction, "residual_db": any_ if worst == -math.inf else worst, "matched": n - start}
    if start:
        first = min(start + WINDOW, n - lag)
        places = np.arange(max(first, 1), max(min(first + min(lag, 44_100), n - lag), 1) + 1)
        cost = np.abs(x[places] - x[places + lag]) + np.abs(x[places - 1] - x[places + lag - 1]) + 0.01 * np.abs(x[places])
        found["intro"] = int(places[np.argmin(cost)])
    return found


def checked(x: np.ndarray, rate: int, lag: int, confirm: int) -> dict | None:
    """`verified` at a whole lag after a quick look at the loudest half second of the last ten."""
    n = max(rate // 2, WINDOW)
    end = len(x) - lag - HALF - 2 - n
    if end < 0 or lag <= HALF:
        return None
    total = np.concatenate([[0.0], np.cumsum(x**2)])
    places = np.append(np.arange(max(0, end - 10 * rate), end + 1, n // 2), end)
    energy = total[places + n] - total[places]
    at = int(places[len(places) - 1 - np.argmax(energy[::-1])])
    left, signal = (math.sqrt((v**2).mean()) for v in (x[at : at + n] - x[at + lag : at + lag + n], x[at : at + n]))
    if signal > 0 and left > LSB and 20 * math.log10(left / signal) > QUICK:
        return None
    return verified(x, lag, fraction_of(x, at, n, lag), max(lag, confirm))


def whole_cycles(exact: float, intro: int, frames: int, rate: int) -> tuple[int, float, int]:
    """(period, exact, cycles) of the body: a period that is no whole number of samples is repeated until it is, within
    two seconds and the sound; else it stays one cycle."""
    most = min(LONGEST_BODY * rate, frames - intro)
    cycles = np.arange(1, max(2, int(most / exact) + 1))
    near = np.flatnonzero(np.abs(cycles * exact - np.round(cycles * exact)) <= WHOLE)
    k = int(cycles[near[0]]) if len(near) and (near[0] == 0 or cycles[near[0]] * exact <= most) else 1
    return round(k * exact), k * exact, k


def seam(x: np.ndarray, start: int, period: int) -> dict:
    """How the end of a body joins its start, in LSB, the most over the channels (frames by channels): the step at the
    joint, the step of the recording itself there, what the joint adds, and the 99th percentile and the largest of the steps in the body."""
    x = x.astype(np.int64).reshape(len(x), -1)
    at = lambda i: x[i] if i < len(x) else np.zeros(x.shape[1], np.int64)
    first, last, after = at(start), at(start + period - 1), at(start + period)
    steps = np.sort(np.abs(np.diff(x[start : start + period], axis=0)).ravel())
    return {
        "joint": int(np.abs(first - last).max()), "natural": int(np.abs(after - last).max()), "error": int(np.abs(first - after).max()),
        "p99": int(steps[(len(steps) - 1) * 99 // 100]) if len(steps) else 0, "largest": int(steps[-1]) if len(steps) else 0,
    }


def loop_of(x: np.ndarray, rate: int = RATE, confirm: float = CONFIRM, hint: float | None = None) -> dict:
    """The loop of a sound with its body and seam; nothing if it has none. With a `hint`, a known period, that alone is
    tried. Of a period found, the largest divisor that holds too is the period."""
    y, need = x.astype(float), int(confirm * rate)
    found = None
    if hint is not None:
        lag = round(hint)
        found = verified(y, lag, hint - lag, max(min(lag, 60 * rate), need))
    else:
        for m in coarse_lags(y, rate, need):
            lag = whole_lag(y, rate, m * HOP, HOP + 8)
            found = checked(y, rate, lag, need) if lag else None
            if found:
                for d in range(found["period"] // max(1, int(SHORTEST * rate)), 1, -1):
                    if part := checked(y, rate, round(found["exact"] / d), need):
                        found = part
                        break
                break
    if not found:
        return {}
    period, exact, cycles = whole_cycles(found["exact"], found["intro"], len(x), rate)
    found |= {"period": period, "exact": exact, "cycles": cycles}
    return found | seam(x, found["intro"], period)


def refined_loops(sounds: DataFrame, pcm: str = "pcm", rate: int = RATE, confirm: float = CONFIRM) -> DataFrame:
    """`sounds` without `pcm`, with the loop of each: intro, repeats_from, period (of the body, in whole samples), exact,
    cycles, residual_db, matched, and the seam's joint, natural, error, p99 and largest step; nulls where there is none, as
    for a null or empty sound. Map-only: a task holds one sound at a time beside its batch."""
    schema = "intro long, repeats_from long, period long, exact double, cycles int, residual_db double, matched long, joint int, natural int, error int, p99 int, largest int"
    return per_sound(sounds, pcm, schema, lambda x: loop_of(x, rate, confirm))
