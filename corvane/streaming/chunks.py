"""Sound that comes in chunks: levels, idle levels and silent tails, kept as state from chunk to chunk."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corvane.operators.signals import SILENCE

OUT = "board string, chunks long, frames long, peak int, idle array<int>, first_loud long, last_loud_end long, silent_run long, closed boolean"
LEVELS = "chunks long, frames long, peak int, idle array<int>, first_loud long, last_loud_end long, silent_run long"
NEW = (0, 0, 0, [], None, None, 0)


def absorb(now: tuple, samples: np.ndarray, silence: int = SILENCE) -> tuple:
    """The state after a chunk (frames by channels): chunks, frames, peak, idle level of each channel, first loud
    frame, the frame after the last loud one, and the silent frames since.

    A channel whose whole chunk spans no more than twice `silence` is idle at the middle of that span, also where it idles
    off zero. A frame is loud if a channel is more than `silence` off its idle level.
    """
    chunks, frames, peak, idle, first, last, silent = now
    level = np.zeros(samples.shape[1], np.int64)
    level[: len(idle)] = idle[: len(level)]
    if len(samples):
        low, high = samples.min(0), samples.max(0)
        level = np.where(high - low <= 2 * silence, np.fix((low + high) / 2).astype(np.int64), level)
        loud = np.flatnonzero((np.abs(samples - level) > silence).any(1))
        peak = max(peak, int(np.abs(samples).max()))
        silent += len(samples)
        if len(loud):
            first = frames + int(loud[0]) if first is None else first
            last = frames + int(loud[-1]) + 1
            silent = len(samples) - 1 - int(loud[-1])
    return chunks + 1, frames + len(samples), peak, level.tolist(), first, last, silent


class Ingest(StatefulProcessor):
    """A board's levels as typed state. Chunks are numbered from zero: one that comes before its turn is held back in a
    map until it is its turn, one that came already is ignored. A board that is `quiet` milliseconds of event time
    without a chunk is closed: its row says so and its state goes, so state does not grow with boards that are gone."""

    def __init__(self, channels: int, silence: int, quiet: int):
        self.channels, self.silence, self.quiet = channels, silence, quiet

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.levels = handle.getValueState("levels", LEVELS)
        self.early = handle.getMapState("early", "ord long", "samples array<int>")
        self.due = handle.getValueState("due", "at long")

    def row(self, key: tuple, now: tuple, closed: bool) -> pd.DataFrame:
        return pd.DataFrame([[key[0], *now, closed]], columns=["board", "chunks", "frames", "peak", "idle", "first_loud", "last_loud_end", "silent_run", "closed"]).astype({"first_loud": "Int64", "last_loud_end": "Int64"})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = tuple(self.levels.get()) if self.levels.exists() else NEW
        latest = -1
        for batch in rows:
            came = dict(zip(reversed(batch["ord"].tolist()), reversed(batch["samples"].tolist())))
            latest = max(latest, int(batch["at_ms"].max()))
            # State is asked only for chunks that were held back: each question goes to the store and back.
            held = self.early.exists()
            while True:
                place = now[0]
                if held and self.early.containsKey((place,)):
                    samples = self.early.getValue((place,))[0]
                    self.early.removeKey((place,))
                    came.pop(place, None)
                elif place in came:
                    samples = came.pop(place)
                else:
                    break
                samples = np.asarray(samples, np.int64)
                now = absorb(now, samples[: len(samples) // self.channels * self.channels].reshape(-1, self.channels), self.silence)
            for place, samples in came.items():
                if place >= now[0] and not (held and self.early.containsKey((place,))):
                    self.early.updateValue((place,), ([int(x) for x in samples],))
        self.levels.update(now)
        due = self.due.get()[0] if self.due.exists() else -1
        if latest + self.quiet > due:
            if due >= 0:
                self.handle.deleteTimer(due)
            self.handle.registerTimer(latest + self.quiet)
            self.due.update((latest + self.quiet,))
        yield self.row(key, now, False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = tuple(self.levels.get()) if self.levels.exists() else NEW
        for state in (self.levels, self.early, self.due):
            state.clear()
        yield self.row(key, now, True)

    def close(self) -> None:
        pass


def chunk_levels(feed: DataFrame, channels: int = 1, silence: int = SILENCE, quiet: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """The levels of each board after each batch, from a stream (board string, ord long, samples array<int> interleaved,
    ts timestamp). Chunks may come in any order. Samples beyond whole frames are left out. Needs a state store
    with several kinds of state (RocksDB); `replay.run_to_end` sets it."""
    from pyspark.sql import functions as F

    ms = int(pd.Timedelta(quiet).total_seconds() * 1000)
    rows = feed.where("board is not null and ord is not null and samples is not null and ts is not null").withWatermark("ts", late)
    rows = rows.select("board", "ord", "samples", "ts", F.unix_millis("ts").alias("at_ms"))
    return rows.groupBy("board").transformWithStateInPandas(Ingest(channels, silence, ms), OUT, "Update", "EventTime")
