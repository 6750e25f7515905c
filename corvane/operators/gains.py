"""Gain with dither: sounds scaled back to 16 bits the same way on every run, each file with a dither of its own."""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Parts of a sound whose dither is generated side by side.
LANES = 512
# Seed, factor and states of the published generators that dither has to equal.
FNV_START, FNV_FACTOR = 0xCBF29CE484222325, 0x100000001B3
FIRST = (0x4B27A8B8, 0x0F033A28, 0x28397F11, 0x486BC179)
SECOND = (0x43719FC0, 0xFFB5A3C0, 0x19C21D46, 0xA8770A93)
MASK = (1 << 32) - 1


def states(name: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The two generators' states for a file name: its FNV-1a hash spread over them."""
    h = FNV_START
    for byte in name.encode():
        h = (h ^ byte) * FNV_FACTOR & (1 << 64) - 1
    one = (FIRST[0] ^ h & MASK, *FIRST[1:3], FIRST[3] ^ h >> 32)
    two = (SECOND[0] ^ h >> 16 & MASK, *SECOND[1:3], SECOND[3] ^ h & MASK)
    return one, two


def step(s: np.ndarray) -> np.ndarray:
    """The next state of each row (four 32-bit words) of an xorshift generator of 128 bits."""
    t = s[:, 0] ^ (s[:, 0] << np.uint32(11))
    last = s[:, 3] ^ (s[:, 3] >> np.uint32(19)) ^ t ^ (t >> np.uint32(8))
    return np.stack([s[:, 1], s[:, 2], s[:, 3], last], 1)


def _bits(s: np.ndarray) -> np.ndarray:
    return np.unpackbits(s.astype("<u4").view(np.uint8).reshape(len(s), 16), axis=1, bitorder="little")


def _words(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view("<u4").reshape(len(bits), 4)


@cache
def jump(power: int) -> np.ndarray:
    """The matrix over bits that takes a state (a row of 128) 2 ** power steps on: a step is linear, so it squares."""
    if power == 0:
        return _bits(step(_words(np.eye(128, dtype=np.uint8))))
    half = jump(power - 1).astype(np.int32)
    return (half @ half % 2).astype(np.uint8)


def uniform(state: tuple[int, ...], n: int, lanes: int = LANES) -> np.ndarray:
    """The next `n` values in [0, 1) of a generator, its top 23 bits: `lanes` parts of a power of two of steps go side by
    side, each from the state that the jump matrix gives."""
    power = max(0, (-(-n // lanes) - 1).bit_length())
    size, matrix = 1 << power, jump(power).astype(np.int32)
    starts = [_bits(np.array([state], np.uint32))]
    while len(starts) * size < n:
        starts.append((starts[-1].astype(np.int32) @ matrix % 2).astype(np.uint8))
    s, out = _words(np.concatenate(starts)), np.empty((size, len(starts)))
    for i in range(size):
        s = step(s)
        out[i] = s[:, 3] >> np.uint32(9)
    return out.T.reshape(-1)[:n] / float(1 << 23)


def scale(samples: np.ndarray, gain: float, name: str) -> tuple[np.ndarray, int]:
    """Samples times `gain` with the difference of two uniform values added, rounded half away from zero, and how many
    were clamped to 16 bits."""
    one, two = (uniform(s, len(samples)) for s in states(name))
    y = samples.astype(float) * gain + (one - two)
    y = np.sign(y) * np.floor(np.abs(y) + 0.5)
    return np.clip(y, -32768, 32767).astype("<i2"), int(((y < -32768) | (y > 32767)).sum())


def scaled(sounds: DataFrame, name: str = "name", pcm: str = "pcm", gain: str = "gain") -> DataFrame:
    """`sounds` with `pcm` scaled by `gain` and `clamped`, the samples that had to be clamped. The name seeds the dither,
    so bytes depend on name, sound and gain alone. A null sound, gain or name gives nulls."""
    kept = [c for c in sounds.columns if c not in (pcm, "clamped")]
    kinds = dict(sounds.dtypes)

    def run(batches):
        for batch in batches:
            found = [(None, None)] * len(batch)
            for i, (n, x, g) in enumerate(zip(batch[name], batch[pcm], batch[gain])):
                if n is not None and x is not None and pd.notna(g):
                    y, clamped = scale(np.frombuffer(x[: len(x) // 2 * 2], "<i2"), float(g), n)
                    found[i] = y.tobytes(), clamped
            out = batch[kept].copy()
            out[pcm], out["clamped"] = [x for x, _ in found], pd.array([c for _, c in found], "Int64")
            yield out

    return sounds.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", `{pcm}` binary, clamped long")
