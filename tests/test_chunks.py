"""Chunks of sound as a stream with typed state, against a plain walk over them."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.streaming import chunks, replay

SCHEMA = "board string, ord long, samples array<int>, ts timestamp"


def walk(parts, channels, silence=2):
    idle, frames, peak, first, last, silent = [0] * channels, 0, 0, None, None, 0
    for part in parts:
        whole = [part[i : i + channels] for i in range(0, len(part) // channels * channels, channels)]
        for c in range(channels):
            own = [f[c] for f in whole]
            if own and max(own) - min(own) <= 2 * silence:
                idle[c] = int((min(own) + max(own)) / 2)
        for f in whole:
            loud = any(abs(s - d) > silence for s, d in zip(f, idle))
            silent = 0 if loud else silent + 1
            peak = max(peak, *map(abs, f))
            if loud:
                first = frames if first is None else first
                last = frames + 1
            frames += 1
    return len(parts), frames, peak, idle, first, last, silent


def sound(r, channels):
    parts, level = [], [r.choice([0, 2056, -301]) for _ in range(channels)]
    for _ in range(r.randrange(1, 12)):
        n, loud = r.randrange(0, 30), r.random() < 0.4
        if r.random() < 0.2:
            level = [r.randrange(-3000, 3000) for _ in range(channels)]
        parts.append([level[c] + (r.randrange(-900, 900) if loud else r.randrange(-2, 3)) for _ in range(n) for c in range(channels)])
    return parts


@pytest.mark.parametrize("channels", [1, 2])
def test_a_chunk_at_a_time_equals_a_walk(channels):
    for seed in range(200):
        parts = sound(random.Random(seed), channels)
        now = chunks.NEW
        for p in parts:
            now = chunks.absorb(now, np.array(p, np.int64).reshape(-1, channels))
        assert now == walk(parts, channels)


def test_a_stream_in_any_order_with_restarts_and_closing(spark, tmp_path):
    r = random.Random(3)
    sounds = {f"b{i}": sound(r, 2) for i in range(6)}
    start = datetime.datetime(2024, 1, 1)
    rows = [(b, i, p, start + datetime.timedelta(seconds=r.randrange(50))) for b, parts in sounds.items() for i, p in enumerate(parts)]
    rows += rows[:5]
    r.shuffle(rows)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    third = len(rows) // 3
    steps = [rows[:third], rows[third : 2 * third], rows[2 * third :], [("late", 0, [1, 1], start + datetime.timedelta(hours=2))], [("last", 0, [9, 9], start + datetime.timedelta(hours=2, seconds=1))]]
    for at, step in enumerate(steps):
        spark.createDataFrame(step, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        found = chunks.chunk_levels(spark.readStream.schema(SCHEMA).parquet(source), channels=2)

        def write(df, batch, at=at):
            df.withColumn("step", F.lit(at)).write.mode("append").parquet(f"{out}/rows")

        with replay.rocks(spark):
            query = found.writeStream.outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{out}/log").foreachBatch(write).start()
        query.awaitTermination()
    got = spark.read.parquet(f"{out}/rows").collect()
    want = {b: walk(parts, 2) for b, parts in sounds.items()}
    for b, w in want.items():
        last = max((x for x in got if x["board"] == b and not x["closed"]), key=lambda x: (x["step"], x["chunks"]))
        assert (last["chunks"], last["frames"], last["peak"], list(last["idle"]), last["first_loud"], last["last_loud_end"], last["silent_run"]) == w
        closed = [x for x in got if x["board"] == b and x["closed"]]
        assert len(closed) == 1 and closed[0]["frames"] == w[1]
    assert not [x for x in got if x["board"] == "last" and x["closed"]]


class Kept(dict):
    """A map state that counts what it is asked to hold."""

    asked = 0

    def exists(self):
        return bool(self)

    def containsKey(self, key):
        self.asked += 1
        return key in self

    def getValue(self, key):
        self.asked += 1
        return self[key]

    def updateValue(self, key, value):
        self.asked += 1
        self[key] = value

    def removeKey(self, key):
        self.asked += 1
        del self[key]


def test_chunks_in_turn_do_not_go_through_the_state():
    from unittest import mock

    import pandas as pd

    for order, most in ((range(50), 0), ([*range(1, 50), 0, 3], 400)):
        ingest, early, now = chunks.Ingest(1, 2, 1000), Kept(), []
        ingest.early, ingest.handle = early, mock.Mock()
        ingest.levels, ingest.due = (mock.Mock(exists=lambda: False) for _ in range(2))
        ingest.levels.update = now.append
        parts = [[i, 3 * i, 7] for i in range(50)]
        # The first of a place counts; two rows go to a batch.
        rows = [pd.DataFrame({"ord": list(order[at : at + 2]), "samples": [np.array(parts[i]) for i in order[at : at + 2]], "at_ms": 5}) for at in range(0, len(order), 2)]
        assert len(list(ingest.handleInputRows(("b",), iter(rows), None))) == 1
        assert now[0] == walk(parts, 1) and early.asked <= most and not early
