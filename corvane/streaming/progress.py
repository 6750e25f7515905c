"""Live feeds as Structured Streaming: progress of jobs, events in windows, last commands."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "job string, pass string, total long, done long, percent double"
STATE = "pass string, total long, least long, at long"


def _step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A job's state is its pass, the pass's size, the least left and the last order seen: a few numbers."""
    now, total, least, at = state.get if state.exists else (None, 0, 0, -1)
    for batch in batches:
        rows = batch.sort_values("ord", kind="stable").drop_duplicates("ord")
        rows = rows[rows["ord"] > at]
        if len(rows):
            # Another pass, or more left than before, starts the count anew: the last start says how much there is.
            stage, left = rows["stage"].to_numpy(object), rows["left"].to_numpy(np.int64)
            starts = np.flatnonzero((stage != np.concatenate([[now], stage[:-1]])) | (left > np.concatenate([[least], left[:-1]])))
            total = left[starts[-1]] if len(starts) else total
            now, least, at = stage[-1], left[-1], rows["ord"].iloc[-1]
    state.update((now, int(total), int(least), int(at)))
    done = total - least
    yield pd.DataFrame({"job": [key[0]], "pass": [now], "total": [total], "done": [done], "percent": [100.0 * done / total if total else 100.0]})


def track(feed: DataFrame) -> DataFrame:
    """Progress of each job after each batch, from a stream (job, ord, stage, left); lines come in any order within a
    batch, and those that are older than what was seen are ignored."""
    return feed.groupBy("job").applyInPandasWithState(_step, OUT, STATE, "update", GroupStateTimeout.NoTimeout)


def progress_lines(feed: DataFrame) -> DataFrame:
    """(job, ord, stage, left) of JSON lines `value`; lines that are no event are left out."""
    parsed = feed.select(F.from_json("value", "job string, ord long, stage string, left long").alias("e")).where("e.job is not null and e.left is not null")
    return parsed.select("e.*")


def windowed_levels(feed: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(user_id, begin, n, level): counts and sums of events in windows; later ones than `late` are dropped, by the
    stream's watermark alone."""
    found = feed.withWatermark("ts", late).groupBy("user_id", F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("level"))
    return found.select("user_id", F.col("w.start").alias("begin"), "n", "level")


def sessions(feed: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """(user_id, begin, finish, n): sessions that end after `gap` without an event."""
    found = feed.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return found.select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")
