"""Queries over sampled series. Events in the order of their ids play the samples, a thousand of them a sound."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import loops as L
from corvane.operators import series as S
from corvane.plans.measured import series
from corvane.plans.registry import query, t
from corvane.session import scratch, stored
from corvane.streaming import chunks, replay, tail

BUCKET, AT = "event_id div 1000", "event_id % 1000"
_SOUND = "event_id // 1000 AS bucket, event_id % 1000 AS i"


def sound(spark, sf_dir, **columns: str):
    """(bucket, i, columns) of all events."""
    found = t(spark, sf_dir, "events").where("event_id is not null")
    return found.selectExpr(f"{BUCKET} as bucket", f"{AT} as i", *[f"cast({text} as bigint) as {name}" for name, text in columns.items()])


_A = "event_id {div} 50 * 37 % 400 + event_id % 2 + CASE WHEN event_id % 50 < CASE WHEN event_id {div} 50 % 7 = 0 THEN 20 ELSE 3 END THEN floor(value) ELSE 0 END"
_B = "event_id {div} 100 * 11 % 60"


@query(f"""
WITH f AS (SELECT {_SOUND}, CAST({_A.format(div="//")} AS BIGINT) AS a, {_B.format(div="//")} AS b FROM events),
m AS (SELECT *, coalesce(abs(a - lag(a) OVER w) > 4 OR abs(b - lag(b) OVER w) > 4, false) AS mv FROM f WINDOW w AS (PARTITION BY bucket ORDER BY i)),
u AS (SELECT *, max(CASE WHEN mv THEN i END) OVER (PARTITION BY bucket ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM m),
n AS (SELECT *, sum(CASE WHEN mv AND (before IS NULL OR i - before > 3) THEN 1 ELSE 0 END) OVER (PARTITION BY bucket ORDER BY i) AS k FROM u),
p AS (SELECT *, lag(last) OVER (PARTITION BY bucket ORDER BY k) AS was FROM (SELECT bucket, k, min(i) AS start, max(i) AS last FROM n WHERE mv GROUP BY ALL)),
e AS (SELECT bucket, max(i) + 1 AS e FROM f GROUP BY bucket),
h AS (SELECT p.bucket, k, max(a) - min(a) <= 16 AND max(b) - min(b) <= 16 AND sqrt(count(*) * sum(a * a) - sum(a) * sum(a)) / count(*) <= 1 AND sqrt(count(*) * sum(b * b) - sum(b) * sum(b)) / count(*) <= 1 AS flat
  FROM p JOIN f ON f.bucket = p.bucket AND f.i >= was AND f.i < start GROUP BY p.bucket, k),
o AS (SELECT p.bucket, p.k, was, coalesce(last - start <= 6 AND start - was > 12 AND flat AND (abs(x.a - y.a) > 4 OR abs(x.b - y.b) > 4), false) AS ok
  FROM p JOIN e USING (bucket) LEFT JOIN h ON h.bucket = p.bucket AND h.k = p.k JOIN f x ON x.bucket = p.bucket AND x.i = start - 1 JOIN f y ON y.bucket = p.bucket AND y.i = least(last + 1, e - 1)),
w AS (SELECT bucket, max(k) FILTER (NOT ok) AS bad FROM o GROUP BY bucket)
SELECT e.bucket, coalesce(c, e) AS cut FROM e LEFT JOIN (SELECT o.bucket, min(was) AS c FROM o JOIN w USING (bucket) WHERE ok AND k > bad GROUP BY o.bucket) USING (bucket)""")
def held_start(spark, sf_dir):
    """WIN2: where a sound of two channels that ends on held levels really ends."""
    frames = sound(spark, sf_dir, a=_A.format(div="div"), b=_B.format(div="div"))
    return S.held_end(frames, ["bucket"], "i", ["a", "b"], gap=3, hold=12, burst=6)


_PERIODIC = "(event_id % 1000) % (5 + event_id {div} 1000 % 9) * 37 % 100 + floor(value) % 3"


@query(f"""
WITH s AS (SELECT {_SOUND}, CAST({_PERIODIC.format(div="//")} AS BIGINT) AS v FROM events),
z AS (SELECT bucket, max(i) + 1 AS k FROM s GROUP BY bucket),
c AS (SELECT a.bucket, CAST(b.i - a.i AS INTEGER) AS lag, sum(abs(a.v - b.v)) / (sum(a.v + b.v) + 1e-9) AS diff FROM s a JOIN s b ON a.bucket = b.bucket AND b.i - a.i BETWEEN 2 AND 40 JOIN z ON z.bucket = a.bucket
  WHERE k - (b.i - a.i) - greatest(b.i - a.i, 20) >= 0 AND a.i >= k - (b.i - a.i) - greatest(b.i - a.i, 20) GROUP BY ALL),
d AS (SELECT *, lag(diff) OVER w AS l, lead(diff) OVER w AS r, min(diff) OVER (PARTITION BY bucket) AS best FROM c WINDOW w AS (PARTITION BY bucket ORDER BY lag))
SELECT bucket, lag, diff, CAST(row_number() OVER (PARTITION BY bucket ORDER BY lag) AS INTEGER) AS rank FROM d
WHERE diff <= least(0.2, greatest(3 * best, best + 0.01)) AND coalesce(l > diff, true) AND coalesce(r >= diff, true) QUALIFY rank <= 16""")
def repeat_lags(spark, sf_dir):
    """WIN12: the lags at which the end of each sound looks like what came before."""
    return S.repeat_lags(sound(spark, sf_dir, v=_PERIODIC.format(div="div")), ["bucket"], "i", "v", most=40, least=2, confirm=20)


@query(f"""
WITH s AS (SELECT {_SOUND}, CAST(floor(value) AS BIGINT) AS v FROM events),
e AS (SELECT bucket, max(i) + 1 - 18 - 40 AS e FROM s GROUP BY bucket),
w AS (SELECT bucket, unnest(list_distinct(list_append(range(greatest(e - 400, 0), e + 1, 20), e))) AS begin FROM e WHERE e >= 0)
SELECT bucket, begin, energy FROM (SELECT w.bucket AS bucket, begin, CAST(sum(v * v) AS BIGINT) AS energy FROM w JOIN s ON s.bucket = w.bucket AND i >= begin AND i < begin + 40 GROUP BY ALL)
QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY energy DESC, begin DESC) = 1""")
def strongest_place(spark, sf_dir):
    """TOP10: the loudest window near the end of each sound, the latest of equals."""
    return S.loudest_window(sound(spark, sf_dir, v="floor(value)"), ["bucket"], "i", "v", length=40, last=400, spare=18)


_MUSIC, _OTHER = "floor(value) - 60", "CASE WHEN event_id % 1000 < 400 THEN 0 ELSE event_id * 7919 % 211 - 105 END"


@query(f"""
WITH s AS (SELECT {_SOUND}, CAST({_MUSIC} AS DOUBLE) AS m, CAST({_OTHER} AS DOUBLE) AS c, event_id FROM events),
x AS (SELECT bucket, i // 30 AS win, m, c, 0.25 * (event_id // 100 % 3 + 1) * m + 0.5 * c + event_id % 3 AS y FROM s),
q AS (SELECT bucket, win, sum(m * m) AS aa, sum(c * c) AS bb, sum(m * c) AS ab, sum(m * y) AS ay, sum(c * y) AS b_y, sum(y * y) AS yy FROM x GROUP BY ALL HAVING count(*) = 30),
d AS (SELECT *, aa * bb - ab * ab AS det, bb < 1e-3 * aa OR abs(aa * bb - ab * ab) < 1e-12 AS alone FROM q),
g AS (SELECT *, CASE WHEN alone THEN ay / greatest(aa, 1e-9) ELSE (ay * bb - b_y * ab) / det END AS gm, CASE WHEN NOT alone THEN (b_y * aa - ay * ab) / det END AS gc FROM d),
r AS (SELECT *, greatest(yy - 2 * gm * ay - 2 * coalesce(gc, 0) * b_y + gm * gm * aa + 2 * gm * coalesce(gc, 0) * ab + coalesce(gc, 0) * coalesce(gc, 0) * bb, 0) AS e FROM g)
SELECT bucket, win AS "window", round(20 * log10(greatest(abs(gm), 1e-6)), 4) AS music_db, CASE WHEN gc IS NOT NULL THEN round(20 * log10(greatest(abs(gc), 1e-6)), 4) END AS other_db,
  round(10 * log10(greatest(e / greatest(yy, 1e-9), 1e-12)), 3) AS residual_db FROM r""")
def least_squares_windows(spark, sf_dir):
    """How loud two aligned signals are in each window of a mix of them."""
    rows = sound(spark, sf_dir, m=_MUSIC, c=_OTHER, step="event_id div 100 % 3 + 1", rest="event_id % 3")
    mixed = rows.withColumn("y", 0.25 * F.col("step") * F.col("m") + 0.5 * F.col("c") + F.col("rest"))
    found = S.mix_gains(mixed, ["bucket"], "i", "y", "m", "c", 30)
    return found.select("bucket", "window", F.round("music_db", 4).alias("music_db"), F.round("other_db", 4).alias("other_db"), F.round("residual_db", 3).alias("residual_db"))


@query(f"""
WITH s AS (SELECT {_SOUND}, CAST({_MUSIC} AS BIGINT) AS v FROM events),
p AS (SELECT a.bucket, b.i + a.bucket % 11 - 5 - a.i AS lag, sum(a.v * b.v) AS s FROM s a JOIN s b ON a.bucket = b.bucket AND b.i + a.bucket % 11 - 5 - a.i BETWEEN -12 AND 12 WHERE a.i < 300 GROUP BY ALL)
SELECT bucket, CAST(lag AS INTEGER) AS lag FROM p QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY s DESC, lag) = 1""")
def mix_lag(spark, sf_dir):
    """By how many places a sound comes after its twin that was moved."""
    left = sound(spark, sf_dir, v=_MUSIC)
    return S.best_lag(left, left.withColumn("i", F.expr("i + bucket % 11 - 5")), ["bucket"], "i", "v", 12, 300)


_LEVEL = "event_id {div} 1000 * 37 % 500 + CASE WHEN event_id {div} 40 % 3 = 0 THEN floor(value) ELSE event_id % 3 END"
_CHUNKS = f"""
WITH s AS (SELECT {_SOUND}, event_id % 1000 // 8 AS ord, CAST({_LEVEL.format(div="//")} AS BIGINT) AS v FROM events),
c AS (SELECT bucket, ord, min(v) AS low, max(v) AS high FROM s GROUP BY ALL),
d AS (SELECT *, coalesce(last_value(CASE WHEN high - low <= 4 THEN trunc((low + high) / 2) END IGNORE NULLS) OVER (PARTITION BY bucket ORDER BY ord), 0) AS idle FROM c)"""


def chunk_table(spark, sf_dir):
    """(bucket, ord, low, high, samples): eight samples a chunk."""
    samples = sound(spark, sf_dir, ord="event_id % 1000 div 8", v=_LEVEL.format(div="div"))
    packed = samples.groupBy("bucket", "ord").agg(F.min("v").cast("int").alias("low"), F.max("v").cast("int").alias("high"), F.array_sort(F.collect_list(F.struct("i", "v"))).alias("s"))
    return packed.select("bucket", "ord", "low", "high", F.transform("s", lambda x: x["v"].cast("int")).alias("samples"))


@query(_CHUNKS + " SELECT bucket, ord, CAST(idle AS INTEGER) AS idle FROM d")
def idle_levels(spark, sf_dir):
    """WIN8: the idle level that holds in each chunk."""
    return S.idle_levels(chunk_table(spark, sf_dir), ["bucket"], "ord", "low", "high", 2).select("bucket", "ord", "idle")


@query(_CHUNKS + """,
l AS (SELECT s.bucket, i, v, abs(v - idle) > 2 AS loud, idle FROM s JOIN d USING (bucket, ord)),
a AS (SELECT bucket, count(DISTINCT i // 8) AS chunks, count(*) AS frames, max(abs(v)) AS peak, arg_max(idle, i) AS idle, min(i) FILTER (loud) AS first_loud, max(i) FILTER (loud) + 1 AS last_loud_end FROM l GROUP BY bucket)
SELECT CAST(bucket AS VARCHAR) AS board, chunks, frames, CAST(peak AS INTEGER) AS peak, CAST(idle AS INTEGER) AS idle, first_loud, last_loud_end, frames - coalesce(last_loud_end, 0) AS silent_run FROM a""")
def chunk_stream(spark, sf_dir):
    """STR1, WIN8, WIN9: levels, idle level and silent tail of each sound, kept from chunk to chunk of a stream."""
    rows = chunk_table(spark, sf_dir).select(F.col("bucket").cast("string").alias("board"), "ord", "samples", F.timestamp_seconds(F.col("ord") + 1_700_000_000).alias("ts"))
    feed = replay.replay(spark, stored(rows, "chunks")._stored_at)
    found = replay.run_to_end(chunks.chunk_levels(feed, quiet="1000 days"), "update")
    last = found.groupBy("board").agg(F.max(F.struct("chunks", "frames", "peak", "idle", "first_loud", "last_loud_end", "silent_run")).alias("x"))
    return last.select("board", "x.chunks", "x.frames", "x.peak", F.get("x.idle", F.lit(0)).alias("idle"), "x.first_loud", "x.last_loud_end", "x.silent_run")


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total, CAST(sum(length(event_type)) AS BIGINT) AS letters FROM events GROUP BY user_id")
def tailed_lines(spark, sf_dir):
    """SRC22: lines of growing files as a stream, parsed and summed up."""
    rows = t(spark, sf_dir, "events").select(F.to_json(F.struct("user_id", F.floor("value").cast("long").alias("v"), "event_type")).alias("value"))
    folder = scratch(spark, "lines")
    rows.write.text(folder)
    found = replay.run_to_end(tail.tail(spark, folder, part=1 << 18), "append")
    parsed = found.select(F.from_json("line", "user_id long, v long, event_type string").alias("e")).select("e.*")
    return parsed.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.sum(F.length("event_type")).alias("letters"))


@query()
def loop_seams(spark, sf_dir):
    """Each sound's loop with its exact period, its body of whole cycles and how its seam sounds."""
    return L.refined_loops(series(spark, sf_dir, 60, 6), confirm=0.5)
