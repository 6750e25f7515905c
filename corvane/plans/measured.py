"""Queries over signals and streams. Series of event values play the sounds."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from corvane.operators import grouping as G
from corvane.operators import sequences as Q
from corvane.operators import signals as S
from corvane.plans.registry import query, t
from corvane.streaming import progress, replay


def sounds(batches, hold: int, times: int):
    """The sounds of rows of values, a few at a time, as they are far longer than the rows that they are made of."""
    for batch in batches:
        for at in range(0, len(batch), S.SOUNDS):
            part = batch.iloc[at : at + S.SOUNDS]
            body = [np.repeat(np.asarray(v, "<i2"), hold) for v in part["v"]]
            yield part[["bucket"]].assign(pcm=[np.concatenate([b[: len(b) // 3][::-1], *[b] * times]).tobytes() for b in body])


def series(spark, sf_dir, hold: int, times: int):
    """(bucket, pcm): the values of 200 events each as samples, held and repeated, with a first part of its own."""
    cents = (F.col("value") * 100 - 8000).cast("int")
    rows = t(spark, sf_dir, "events").select(F.expr("event_id div 200").alias("bucket"), F.struct("event_id", F.greatest(F.least(cents, F.lit(32000)), F.lit(-32000)).alias("v")).alias("e"))
    # Few bytes, much work: as many tasks as there are partitions, which Spark would join for so small a table.
    rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "bucket")
    rows = rows.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]).alias("v"))

    return rows.mapInPandas(lambda batches: sounds(batches, hold, times), "bucket long, pcm binary")


@query()
def sound_levels(spark, sf_dir):
    """K2-K6, WIN1: levels, clipping and loudness blocks of each sound."""
    found = S.measure(series(spark, sf_dir, 12, 8))
    return found.select("bucket", "frames", "peak_dbfs", "rms_dbfs", "true_peak_dbtp", "clipped", "clip_events", "onset", "last_loud", F.size("energies").alias("blocks"))


@query()
def loudness(spark, sf_dir):
    """K5, AGG13, AGG14: gated loudness of each group of sounds."""
    found = S.measure(series(spark, sf_dir, 12, 8)).withColumn("part", F.col("bucket") % 5)
    return S.loudness(found, ["part"])


@query()
def loop_find(spark, sf_dir):
    """The period at which each sound repeats, and where its loop begins."""
    return S.find_loops(series(spark, sf_dir, 12, 8))


@query()
def sound_twins(spark, sf_dir):
    """J18, K15, K16, UPS8: sounds that are an earlier one of their group once more, each sound being there twice."""
    once = series(spark, sf_dir, 4, 2).withColumn("part", F.col("bucket") % 3)
    again = once.withColumn("bucket", F.col("bucket") + 1_000_000)
    return S.find_twins(once.unionByName(again), ["part"], "bucket")


@query("""
WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, value FROM events),
y AS (SELECT user_id, i, value, CAST(0 AS DOUBLE) AS y FROM s WHERE i = 0
  UNION ALL SELECT s.user_id, s.i, s.value, s.value - y.value + y.y * exp(-2 * pi() * 10 / 44100) FROM y JOIN s ON s.user_id = y.user_id AND s.i = y.i + 1)
SELECT user_id, i, round(y, 5) AS y FROM y""")
def dc_block(spark, sf_dir):
    """K2: each user's series without its idle level."""
    rows = t(spark, sf_dir, "events").select("user_id", "event_id", "value")
    found = Q.decayed(rows, ["user_id"], ["event_id"], "value", math.exp(-2 * math.pi * S.DC_HZ / S.RATE))
    return found.select("user_id", "i", F.round("y", 5).alias("y"))


@query()
def adpcm_decode(spark, sf_dir):
    """Samples from 4-bit codes."""
    codes = F.sha2(F.concat_ws(":", F.col("event_id").cast("string"), F.col("event_type")), 256)
    found = S.decode_adpcm(t(spark, sf_dir, "events").select("event_id", F.unhex(codes).alias("data")))
    return found.select("event_id", F.length("pcm").alias("n_bytes"), F.crc32("pcm").alias("crc"))


@query("""SELECT user_id, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS begin_us, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY ALL""")
def stream_windows(spark, sf_dir):
    """STR1, WIN10: daily windows of a replayed stream; equal to the same windows of the table."""
    feed = replay.replay(spark, f"{sf_dir}/events.parquet").withColumn("cents", F.round(F.col("value") * 100).cast("long"))
    # Every row belongs to the result, so the state is kept for the whole replay: no watermark.
    found = feed.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    from corvane.functions.exprs import micros

    rows = replay.run_to_end(found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("begin"), "n", "cents"), "complete")
    last = rows.agg(F.max("batch_id").alias("batch_id"))
    return rows.join(F.broadcast(last), "batch_id").select("user_id", micros("begin").alias("begin_us"), "n", "cents")  # one row


@query()
def progress_stream(spark, sf_dir):
    """STR5, WIN21, SNK13: progress of each user's job from a replayed feed."""
    feed = replay.replay(spark, f"{sf_dir}/events.parquet").where("event_id is not null and user_id is not null")
    lines = feed.select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("ord"), F.col("event_type").alias("stage"), F.floor("value").cast("long").alias("left"))
    rows = replay.run_to_end(progress.track(lines), "update")
    return G.best_by(rows, ["job"], [-F.col("batch_id")], ["pass", "total", "done", "percent"])
