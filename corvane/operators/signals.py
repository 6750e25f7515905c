"""Signals: sampled sounds as one binary row each (16-bit little-endian mono), measured in Arrow batches.

A row is a whole sound, so its kernels run inside a task while Spark deals out the rows; nothing is grouped or shuffled
until the relational part. A null or empty sound gives nulls. All run on `mapInPandas`, batch by batch.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RATE, SILENCE, DC_HZ, CLIP_GAP = 44_100, 2, 10.0, 0.010
#: Sounds that a kernel hands on together.
SOUNDS = 16


def per_sound(sounds: DataFrame, pcm: str, schema: str, kernel: Callable[[np.ndarray], dict]) -> DataFrame:
    """`sounds` without its `pcm`, with the columns of `schema` that `kernel` gives for each sound's samples."""
    keep = [c for c in sounds.columns if c != pcm]
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = [kernel(np.frombuffer(x, "<i2")) if x else {} for x in batch[pcm]]
            yield pd.concat([batch[keep].reset_index(drop=True), pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)], axis=1)

    kept = ", ".join(f"`{c}` {k}" for c, k in sounds.drop(pcm).dtypes)
    return sounds.mapInPandas(run, f"{kept}, {schema}")


def one_pole(x: np.ndarray, r: float, block: int = 256) -> np.ndarray:
    """y[n] = x[n] + r y[n-1], block by block as a product with a triangle of powers."""
    powers = r ** np.arange(block + 1)
    lower = np.tril(powers[np.abs(np.subtract.outer(np.arange(block), np.arange(block)))])
    out, carry = np.empty(len(x)), 0.0
    for at in range(0, len(x), block):
        part = x[at : at + block]
        n = len(part)
        out[at : at + n] = lower[:n, :n] @ part + powers[1 : n + 1] * carry
        carry = out[at + n - 1]
    return out


def dc_blocked(x: np.ndarray, rate: int = RATE, corner: float = DC_HZ) -> np.ndarray:
    """Samples without their idle level: a one-pole high pass that starts settled on the first sample."""
    r = math.exp(-2 * math.pi * corner / rate)
    step = np.diff(x.astype(float), prepend=x[:1])
    return one_pole(step, r)


def biquad(x: np.ndarray, b: tuple, a: tuple, block: int = 128) -> np.ndarray:
    """A second-order filter by its impulse and state responses, block by block."""
    n = block
    step = np.array([[-a[1], 1.0], [-a[2], 0.0]])
    gain = np.array([b[1] - a[1] * b[0], b[2] - a[2] * b[0]])
    impulse, from_state, powers = np.zeros(n), np.zeros((n, 2)), np.eye(2)
    push = np.zeros((n, 2))
    for i in range(n):
        from_state[i] = powers[0]
        impulse[i] = b[0] if i == 0 else from_state[i - 1] @ gain
        push[i] = powers @ gain
        powers = powers @ step
    toeplitz = np.tril(impulse[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))])
    full = np.linalg.matrix_power(step, n)
    out, state = np.empty(len(x)), np.zeros(2)
    for at in range(0, len(x), n):
        part = x[at : at + n]
        k = len(part)
        out[at : at + k] = toeplitz[:k, :k] @ part + from_state[:k] @ state
        if k == n:
            state = full @ state + push[::-1].T @ part
    return out


def k_weighted(x: np.ndarray, rate: int = RATE) -> np.ndarray:
    """The weighting of ITU-R BS.1770: a shelf for the head and a high pass, derived for any rate."""
    # The analogue prototypes of the recommendation's two filters.
    f0, g, q = 1681.974450955533, 3.999843853973347, 0.7071752369554196
    k, vh = math.tan(math.pi * f0 / rate), 10 ** (g / 20)
    vb = vh**0.4996667741545416
    d = 1 + k / q + k * k
    shelf = (vh + vb * k / q + k * k) / d, 2 * (k * k - vh) / d, (vh - vb * k / q + k * k) / d
    x = biquad(x, shelf, (1.0, 2 * (k * k - 1) / d, (1 - k / q + k * k) / d))
    f1, q1 = 38.13547087602444, 0.5003270373238773
    k = math.tan(math.pi * f1 / rate)
    d = 1 + k / q1 + k * k
    return biquad(x, (1.0, -2.0, 1.0), (1.0, 2 * (k * k - 1) / d, (1 - k / q1 + k * k) / d))


def block_energies(x: np.ndarray, rate: int = RATE, channels: int = 2) -> np.ndarray:
    """Mean squares of 400 ms every 100 ms; a mono sound counts as two channels; a shorter sound is padded."""
    step = rate // 10
    y = k_weighted(x / 32768.0, rate)
    if len(y) < 4 * step:
        y = np.pad(y, (0, 4 * step - len(y)))
    steps = (y[: len(y) // step * step].reshape(-1, step) ** 2).sum(1)
    return channels * np.convolve(steps, np.ones(4), "valid") / (4 * step)


def true_peak(x: np.ndarray, up: int = 4, half: int = 8) -> float:
    """The peak between the samples, as a share of full scale: windowed-sinc interpolation by `up`."""
    padded, peak = np.pad(x.astype(float), half), float(np.abs(x).max(initial=0))
    taps = np.arange(-half + 1, half + 1)
    for phase in range(1, up):
        t = taps - phase / up
        peak = max(peak, float(np.abs(np.convolve(padded, (np.sinc(t) * np.sinc(t / half))[::-1], "valid")).max(initial=0)))
    return peak / 32768


def clip_events(x: np.ndarray, rate: int = RATE, gap: float = CLIP_GAP) -> list[tuple[int, int, int]]:
    """(first, last, samples) of stretches at full scale that are no more than `gap` seconds apart."""
    at = np.flatnonzero((x >= 32767) | (x <= -32768))
    parts = np.split(at, np.flatnonzero(np.diff(at) > gap * rate) + 1) if len(at) else []
    return [(int(p[0]), int(p[-1]), len(p)) for p in parts]


def measure(sounds: DataFrame, pcm: str = "pcm", rate: int = RATE) -> DataFrame:
    """`sounds` with frames, peak and rms in dBFS, true peak in dBTP, clipped samples and clip events, first and last
    frame over silence, and the energies of their loudness blocks."""

    def kernel(x: np.ndarray) -> dict:
        y = dc_blocked(x, rate)
        db = lambda v: 20 * math.log10(v) if v > 0 else None
        loud, clips = np.flatnonzero(np.abs(y) > SILENCE), clip_events(x, rate)
        return {
            "frames": len(x), "peak_dbfs": db(np.abs(y).max() / 32768), "rms_dbfs": db(math.sqrt((y**2).mean()) / 32768), "true_peak_dbtp": db(true_peak(y)),
            "clipped": sum(c[2] for c in clips), "clip_events": len(clips), "onset": int(loud[0]) if len(loud) else None, "last_loud": int(loud[-1]) if len(loud) else None, "energies": block_energies(y, rate).tolist(),
        }

    return per_sound(sounds, pcm, "frames long, peak_dbfs double, rms_dbfs double, true_peak_dbtp double, clipped long, clip_events int, onset long, last_loud long, energies array<double>", kernel)


def loudness(measured: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, files, seconds, lufs, true_peak_dbtp): gated loudness over all blocks of a group's measured sounds."""
    from corvane.operators.grouping import gated

    files = measured.groupBy(*keys).agg(F.count("frames").alias("files"), (F.sum("frames") / RATE).alias("seconds"), F.max("true_peak_dbtp").alias("true_peak_dbtp"))
    levels = gated(measured.select(*keys, F.explode_outer("energies").alias("energy")), keys, "energy")
    return files.join(levels.select(*keys, "lufs"), keys, "left").select(*keys, "files", "seconds", "lufs", "true_peak_dbtp")


def loop_of(x: np.ndarray, rate: int = RATE, least: float = 0.05, tolerance_db: float = -30.0) -> dict:
    """period (in samples, with a fraction), intro and residual_db of the shortest period that the rest of a sound
    repeats with; nothing if none does within `tolerance_db`.

    Autocorrelation by FFT proposes lags; each is verified on the tail by its residual and refined by a parabola; then
    windows are walked back from the end while they still repeat, which leaves the intro.
    """
    y = x.astype(float) - x.mean()
    n, low = len(y), max(8, int(least * rate))
    if n < 3 * low or not y.any():
        return {}
    tail = y[n // 3 :]
    m = len(tail)
    size = 1 << (2 * m - 1).bit_length()
    spectrum = np.fft.rfft(tail, size)
    auto = np.fft.irfft(spectrum * spectrum.conj(), size)[:m]
    square = np.concatenate([[0.0], np.cumsum(tail**2)])
    lags = np.arange(m)
    energy = (square[m - lags] + square[m] - square[lags]) / 2
    score = auto / np.maximum(energy, 1e-9)
    top = m // 2 + 1
    peaks = np.flatnonzero((score[1 : top - 1] >= score[: top - 2]) & (score[1 : top - 1] > score[2:top])) + 1
    for lag in peaks[(peaks >= low) & (score[peaks] > 0.9)]:
        a, b = tail[lag:], tail[:-lag]
        residual = 10 * math.log10(max(((a - b) ** 2).mean(), 1e-12) / max((a**2).mean(), 1e-12))
        left, mid, right = score[lag - 1 : lag + 2]
        bend = left - 2 * mid + right
        shift = 0.5 * (left - right) / bend if bend else 0.0
        if residual <= tolerance_db:
            window, start = max(256, low // 4), n - lag
            while start >= window:
                e = y[start - window : start] - y[start - window + lag : start + lag]
                if (e**2).mean() > max(16.0, 10 ** (tolerance_db / 10) * (y[start - window + lag : start + lag] ** 2).mean()):
                    break
                start -= window
            return {"period": float(lag + shift), "intro": int(start if start >= window else 0), "residual_db": residual}
    return {}


def find_loops(sounds: DataFrame, pcm: str = "pcm", rate: int = RATE) -> DataFrame:
    return per_sound(sounds, pcm, "period double, intro long, residual_db double", lambda x: loop_of(x, rate))


def shifting(shift: float, half: int = 24) -> np.ndarray:
    """The windowed sinc that delays samples by `shift`."""
    t = np.arange(-half, half + 1) - shift
    near = np.clip(t / (half + 1), -1, 1)
    return np.sinc(t) * (0.42 + 0.5 * np.cos(np.pi * near) + 0.08 * np.cos(2 * np.pi * near))


def aligned_residual(a: np.ndarray, b: np.ndarray, most: int = 3, half: int = 24) -> float:
    """The level in dB of what is left of `b` under `a` at the best shift of up to `most` samples and a fraction."""
    n = min(len(a), len(b))
    a, b, inside = a[:n].astype(float), b[:n].astype(float), slice(half + most, n - half - most)

    def left(shift: float) -> float:
        e = a[inside] - np.convolve(b, shifting(shift, half), "same")[inside]
        return 10 * math.log10(max((e**2).mean(), 1e-12) / max((a[inside] ** 2).mean(), 1e-12))

    best = min(range(-most, most + 1), key=left)
    lo, hi, ratio = best - 1.0, best + 1.0, (math.sqrt(5) - 1) / 2
    for _ in range(24):
        p, q = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, q) if left(p) < left(q) else (p, hi)
    return left((lo + hi) / 2)


#: Radians a sample at which sounds are marked, and samples of a sound that are marked together.
MARKS, MARKED = (0.0, 0.06, 0.13, 0.25, 0.4, 0.6), 1 << 16


@functools.cache
def _responses(most: int, half: int) -> tuple[np.ndarray, ...]:
    """What shifts of up to `most` + 1 do: the least and largest gain and the largest slope at each of MARKS, the largest gain
    at any frequency, and the largest weight of each tap, with room for shifts between those tried."""
    kernels = np.stack([shifting(s, half) for s in np.linspace(-most - 1, most + 1, 1024 * (most + 1) + 1)])
    taps = np.arange(-half, half + 1)
    wave = np.exp(-1j * np.outer(taps, MARKS))
    gains, slopes = np.abs(kernels @ wave), np.abs((kernels * taps) @ wave)
    return gains.min(0) - 0.002, gains.max(0) + 0.002, slopes.max(0) * 1.01, np.abs(np.fft.fft(kernels[::16], 1024)).max() * 1.02, np.abs(kernels).max(0) + 0.004


@functools.lru_cache(4)
def _waves(begin: int, end: int, edge: int, m: int) -> tuple[np.ndarray, float]:
    """Samples `begin` to `end` of a window of `m`, turned by each of MARKS, and the sum of its squares."""
    i = np.arange(begin, end)
    window = np.sin(np.pi * (i + 0.5) / m)
    turn = np.outer(i + edge, MARKS)
    return window[:, None] * np.concatenate([np.cos(turn), -np.sin(turn)], 1), float((window**2).sum())


def marks(x: np.ndarray, n: int, most_db: float, most: int = 3, half: int = 24) -> list[float] | None:
    """Levels of the first `n` samples at MARKS, and the least and largest that one may have at them of which this is a twin.

    If `aligned_residual` finds x under a with a residual of `most_db`, each level of a is within the bounds of x: a level
    is a product with a wide window, that differs by no more than the residual's norm from that of x as shifted. A
    shift turns the phase of x and hardly its level: by the shift's gain, and by how the level changes as the window moves,
    which is taken from x itself. None if there are too few samples for a residual.
    """
    edge = half + most
    m = n - 2 * edge
    if m <= 0:
        return None
    least, largest, slope, gain, weight = _responses(most, half)
    b, taps = x[:n].astype(float), np.arange(-half, half + 1)
    got, window = np.zeros((len(taps), 2 * len(MARKS))), 0.0
    for begin in range(0, m, MARKED):
        end = min(m, begin + MARKED)
        waves, square = _waves(begin, end, edge, m)
        got += np.lib.stride_tricks.sliding_window_view(b[edge - half + begin : edge + half + end], end - begin)[::-1] @ waves
        window += square
    level = (got[:, : len(MARKS)] + 1j * got[:, len(MARKS) :]) * np.exp(1j * np.outer(taps, MARKS))
    at = level[half]
    step = (level[half + 1] - level[half - 1]) / 2
    rest = weight @ np.abs(level - at - np.outer(taps, step))
    share = 10 ** (most_db / 20)
    room = slope * np.abs(step) + rest + (gain * share / (1 - share) + 1e-6) * math.sqrt(window) * math.sqrt(b @ b)
    return [*np.abs(at), *(least * np.abs(at) - room), *(largest * np.abs(at) + room)]


def may_be_twins(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """Whether the marks of sound a are within the bounds of b, over the samples of the shorter."""
    own = lambda x, y: F.when(x("frames") > y("frames"), x("__less")).otherwise(x("__own"))
    point, bounds, k = own(a, b), own(b, a), len(MARKS)
    return reduce(lambda x, y: x & y, [point[i].between(bounds[k + i], bounds[2 * k + i]) for i in range(k)])


def find_twins(sounds: DataFrame, keys: list[str], sound: str = "sound", pcm: str = "pcm", most_db: float = -60.0) -> DataFrame:
    """(keys, item, leader): sounds that are an earlier one of their group once more: lengths within a sample, levels
    within 0.01 LU, and a residual of at most `most_db`. A band join proposes pairs, bounds of their marks rule out what no shift
    can align, and the kernel verifies the rest.

    Of equal sounds only the first is compared with others: it is what leads the rest, or it has their leader. That holds
    where a sound is found in itself; one that is not (silent but for its ends, or too short) stands for itself alone.
    """
    from corvane.operators.grouping import gated
    from corvane.operators.matching import _few, band, leaders
    from corvane.session import stored

    kinds, marked = dict(sounds.dtypes), most_db < 0
    sounds = stored(sounds.select(*keys, sound, pcm), "sounds")

    def kernel(x: np.ndarray) -> dict:
        own, less = ((marks(x, n, most_db) for n in (len(x), len(x) - 1)) if marked else (None, None))
        return {"energies": block_energies(dc_blocked(x)).tolist(), "__own": own, "__less": less}

    sized = sounds.select(*keys, sound, pcm, (F.length(pcm) / 2).alias("frames"), F.sha2(pcm, 256).alias("__same"))
    sized = stored(per_sound(sized, pcm, "energies array<double>, __own array<double>, __less array<double>", kernel), "marked")
    levels = gated(sized.select(*keys, sound, F.explode_outer("energies").alias("energy")), [*keys, sound], "energy").select(*keys, sound, "lufs")
    sized = stored(sized.drop("energies").join(levels, [*keys, sound]), "sized")
    equal = sized.where("lufs is not null").groupBy(*keys, "__same").agg(F.min(sound).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    equal = stored(equal, "equal")
    firsts = sounds.join(_few(equal.select(*keys, F.col("__first").alias(sound)), equal.count()), [*keys, sound], "left_semi").select(*keys, sound, pcm)
    whole = per_sound(firsts, pcm, "db double", lambda x: {"db": aligned_residual(x, x)}).where((F.col("db") <= most_db) & ~F.isnan("db"))
    equal = equal.join(whole.select(*keys, F.col(sound).alias("__first")), [*keys, "__first"])
    copies = sized.join(equal, [*keys, "__same"]).where(F.col(sound) != F.col("__first")).select(*keys, sound, "__first")
    copies = stored(copies, "copies")
    single = sized.join(copies, [*keys, sound], "left_anti").drop("__same")
    pairs = stored(band(single, keys, [("frames", 1.0), ("lufs", 0.01)], sound, *[(["frames", "__own", "__less"], may_be_twins)] * marked), "near")
    few = _few(pairs, pairs.count())
    both = few.join(sounds.select(*keys, F.col(sound).alias("a"), F.col(pcm).alias("pa")), [*keys, "a"])
    both = both.join(sounds.select(*keys, F.col(sound).alias("b"), F.col(pcm).alias("pb")), [*keys, "b"])

    def verify(batches):
        for batch in batches:
            near = [aligned_residual(np.frombuffer(x, "<i2"), np.frombuffer(y, "<i2")) <= most_db for x, y in zip(batch["pa"], batch["pb"])]
            yield batch.loc[near, [*keys, "a", "b"]]

    found = both.select(*keys, "a", "b", "pa", "pb").mapInPandas(verify, ", ".join(f"{c} {kinds[c]}" for c in keys) + f", a {kinds[sound]}, b {kinds[sound]}")
    led = leaders(found, keys)
    behind = led.select(*keys, F.col("item").alias("__first"), "leader")
    behind = copies.join(behind, [*keys, "__first"], "left").select(*keys, F.col(sound).alias("item"), F.coalesce("leader", "__first").alias("leader"))
    return led.unionByName(behind)


def mix_gains(mix: np.ndarray, music: np.ndarray, other: np.ndarray, window: int) -> np.ndarray:
    """(gain of music, gain of other, residual share) for each whole window of a mix, by least squares."""
    n = min(map(len, (mix, music, other))) // window * window
    y, m, c = (v[:n].astype(float).reshape(-1, window) for v in (mix, music, other))
    mm, cc, mc, ym, yc = (m * m).sum(1), (c * c).sum(1), (m * c).sum(1), (y * m).sum(1), (y * c).sum(1)
    det = np.where(np.abs(mm * cc - mc * mc) < 1e-9, np.nan, mm * cc - mc * mc)
    gm, gc = (ym * cc - yc * mc) / det, (yc * mm - ym * mc) / det
    left = ((y - gm[:, None] * m - gc[:, None] * c) ** 2).sum(1) / np.maximum((y * y).sum(1), 1e-12)
    return np.stack([gm, gc, left], 1)


def best_lag(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """By how many samples `b` has to move to fit `a` best, within `most`."""
    size = 1 << (len(a) + len(b)).bit_length()
    cross = np.fft.irfft(np.fft.rfft(a.astype(float), size) * np.fft.rfft(b.astype(float), size).conj(), size)
    lags = np.arange(-most, most + 1)
    return int(lags[np.argmax(cross[lags])])


#: Bytes of codes that are decoded together.
TOGETHER = 1 << 22
# By how much a code of IMA ADPCM moves the index of its step.
INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2)


def steps() -> list[int]:
    """The 89 quantiser steps of the format."""
    # Published with the format.
    return [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449,
        494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493,
        10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
    ]


def ima_decode(data: bytes, value: int = 0, index: int = 0) -> np.ndarray:
    """Samples of 4-bit codes, the low half of a byte first."""
    raw, table, out = np.frombuffer(data, np.uint8), steps(), []
    for code in np.stack([raw & 15, raw >> 4], 1).reshape(-1).tolist():
        step = table[index]
        delta = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
        value = max(-32768, min(32767, value - delta if code & 8 else value + delta))
        index = max(0, min(88, index + int(INDEX[code])))
        out.append(value)
    return np.array(out, "<i2")


def ima_decode_all(streams: list[bytes]) -> list[np.ndarray]:
    """What ima_decode gives for each stream; streams of about one length go step by step together, as many as TOGETHER
    bytes hold, so memory does not follow their number times the longest."""
    out: list[np.ndarray] = [np.zeros(0, "<i2")] * len(streams)
    classes: dict[int, list[int]] = {}
    for i, x in enumerate(streams):
        classes.setdefault(len(x).bit_length(), []).append(i)
    table, change = np.array(steps()), np.asarray(INDEX, np.int64)
    parts = [rows[at : at + n] for size, rows in classes.items() for n in [max(8, TOGETHER >> size)] for at in range(0, len(rows), n)]
    for rows in parts:
        if len(rows) < 8:
            for i in rows:
                out[i] = ima_decode(streams[i])
            continue
        longest = max(len(streams[i]) for i in rows)
        raw = np.frombuffer(b"".join(streams[i].ljust(longest, b"\0") for i in rows), np.uint8).reshape(len(rows), longest)
        codes = np.ascontiguousarray(np.stack([raw & 15, raw >> 4], 2).reshape(len(rows), -1).T)
        value, index, samples = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), np.empty(codes.shape, "<i2")
        for at, code in enumerate(codes):
            step = table[index]
            delta = (step >> 3) + (step * (code >> 2 & 1)) + ((step >> 1) * (code >> 1 & 1)) + ((step >> 2) * (code & 1))
            value = np.clip(np.where(code & 8, value - delta, value + delta), -32768, 32767)
            index = np.clip(index + change[code], 0, 88)
            samples[at] = value
        samples = samples.T
        for row, i in enumerate(rows):
            out[i] = samples[row, : 2 * len(streams[i])]
    return out


def decode_adpcm(streams: DataFrame, data: str = "data") -> DataFrame:
    """`streams` with `pcm` in place of their coded `data`; null stays null. Map-only."""

    @F.pandas_udf("binary")
    def of(codes: pd.Series) -> pd.Series:
        has = codes.notna()
        out = pd.Series([None] * len(codes), index=codes.index, dtype=object)
        out[has] = pd.Series([x.tobytes() for x in ima_decode_all(codes[has].tolist())], index=codes.index[has], dtype=object)
        return out

    return streams.select(*[c for c in streams.columns if c != data], of(F.col(data)).alias("pcm"))
