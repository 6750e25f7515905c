"""Queries over ordered rows: islands, runs, fills, blocks, recurrences, over events in the order of time and id."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import sequences as S
from corvane.plans.registry import query, t

ORDER = ["moment", "event_id"]
HOUR = 3_600_000_000


def events(spark, sf_dir):
    return t(spark, sf_dir, "events").withColumn("moment", X.micros("ts"))


_E = "WITH e AS (SELECT *, epoch_us(ts) AS moment FROM events)"
_W = "(PARTITION BY user_id ORDER BY moment, event_id)"


@query(f"""
{_E}, n AS (SELECT *, CASE WHEN moment - lag(moment) OVER {_W} <= {HOUR} THEN 0 ELSE 1 END AS new FROM e),
g AS (SELECT *, sum(new) OVER {_W} AS id FROM n)
SELECT user_id, min(moment) AS first, max(moment) AS last, count(*) AS n FROM g GROUP BY user_id, id""")
def gap_islands(spark, sf_dir):
    """WIN1: each user's stretches of events an hour or less apart."""
    return S.islands(events(spark, sf_dir), ["user_id"], "moment", HOUR, ["event_id"])


@query(f"""
{_E}, a AS (SELECT *, row_number() OVER {_W} - 1 AS r, row_number() OVER {_W} - row_number() OVER (PARTITION BY user_id, event_type ORDER BY moment, event_id) AS g FROM e),
b AS (SELECT user_id, event_type, g, min(r) AS "begin", count(*) AS n FROM a GROUP BY ALL)
SELECT user_id, event_type, "begin", n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, "begin") AS k FROM b) WHERE k = 1""")
def longest_run(spark, sf_dir):
    """WIN3: the longest run of one kind of event, the first of equals."""
    return S.longest_run(events(spark, sf_dir), ["user_id"], ORDER, "event_type")


@query(f"""{_E} SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY moment, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM e""")
def forward_fill(spark, sf_dir):
    """WIN4, WIN8: the last signup up to each event."""
    heading = F.when(F.col("event_type") == "signup", F.col("event_id"))
    return S.forward_fill(events(spark, sf_dir), ["user_id"], ORDER, heading, "heading").select("event_id", "heading")


@query("""SELECT user_id, event_type, min(event_id) AS place, arg_max(props, event_id) AS props FROM events GROUP BY ALL""")
def first_pos_last_name(spark, sf_dir):
    """WIN5: a repeated key keeps its first place and takes its last text."""
    return S.first_place_last_name(events(spark, sf_dir), ["user_id", "event_type"], F.col("event_id"), "props")


@query("""
SELECT l_returnflag, l_discount, CASE WHEN l_discount < 0.1 THEN dense_rank() OVER (PARTITION BY l_returnflag, l_discount < 0.1 ORDER BY l_discount DESC) ELSE 0 END AS profile
FROM (SELECT DISTINCT l_returnflag, l_discount FROM lineitem)""")
def duck_profiles(spark, sf_dir):
    """WIN6: settings numbered by depth, the lightest first."""
    return S.profiles(t(spark, sf_dir, "lineitem"), "l_returnflag", "l_discount", 0.1)


@query(f"""
{_E}, p AS (SELECT user_id, lag(event_type) OVER {_W} AS before, event_type, moment FROM e)
SELECT user_id, before, event_type, min(moment) AS moment FROM p GROUP BY ALL""")
def novelty(spark, sf_dir):
    """WIN7: when a kind of event first followed another."""
    return S.novelty(events(spark, sf_dir), ["user_id"], ORDER, "event_type", "moment")


_BLOCKS = f"""
{_E}, r AS (SELECT user_id, value, (row_number() OVER {_W} - 1) // 5 AS block FROM e),
b AS (SELECT user_id, block, sqrt(avg(value * value)) AS rms FROM r GROUP BY ALL HAVING count(*) = 5)"""


@query(_BLOCKS + " SELECT * FROM b")
def envelope(spark, sf_dir):
    """WIN10: levels of whole blocks of five values."""
    return S.blocks(events(spark, sf_dir), ["user_id"], ORDER, 5, "value")


@query(_BLOCKS + """, s AS (SELECT user_id, block, avg(rms) OVER w AS mean, count(*) OVER w AS c FROM b WINDOW w AS (PARTITION BY user_id ORDER BY block ROWS 3 PRECEDING))
SELECT user_id, block, mean FROM s WHERE c = 4""")
def sliding_blocks(spark, sf_dir):
    """WIN11: means over four blocks, a block apart."""
    return S.sliding(envelope(spark, sf_dir), ["user_id"], "block", "rms", 4)


@query("""
WITH s AS (SELECT event_id // 50 AS bucket, event_id % 50 AS i, CAST(round(value * 100) AS BIGINT) AS v FROM events)
SELECT a.bucket, CAST(b.i - a.i AS INTEGER) AS lag, count(*) AS n, CAST(sum(abs(a.v - b.v)) AS BIGINT) AS diff
FROM s a JOIN s b ON a.bucket = b.bucket AND b.i - a.i BETWEEN 1 AND 12 GROUP BY ALL""")
def lag_autocorr(spark, sf_dir):
    """WIN12: how much a series differs from itself some places on."""
    cents = F.round(F.col("value") * 100).cast("long")
    series = t(spark, sf_dir, "events").select(F.expr("event_id div 50").alias("bucket"), (F.col("event_id") % 50).alias("i"), cents.alias("v"))
    return S.lag_difference(series, ["bucket"], "i", "v", 12)


@query(f"""
{_E}, p AS (SELECT user_id, event_type, row_number() OVER {_W} AS moment FROM e),
d AS (SELECT user_id, moment - lag(moment) OVER (PARTITION BY user_id, event_type ORDER BY moment) AS distance FROM p)
SELECT user_id, distance, count(*) AS n FROM d WHERE distance > 1 GROUP BY ALL HAVING count(*) >= 2""")
def state_recurrence(spark, sf_dir):
    """WIN13: distances at which states come back, found twice at least."""
    placed = S.numbered(events(spark, sf_dir), ["user_id"], ORDER, "place")
    return S.recurrence(placed, ["user_id"], "place", "event_type")


@query(f"""
{_E}, s AS (SELECT user_id, ((b - lag(b) OVER {_W}) % 256 + 256) % 256 AS s FROM (SELECT *, CAST(floor(value) AS BIGINT) AS b FROM e))
SELECT user_id, count(*) AS n, count(*) FILTER (s <> 0) AS changes, coalesce(bool_and(s BETWEEN 1 AND 64) FILTER (s <> 0), false) AS rising,
  count(*) FILTER (s <> 0) >= 0.5 * greatest(count(*) - 1, 1) AS is_fast FROM s GROUP BY user_id""")
def column_profile(spark, sf_dir):
    """WIN14: how a byte moves."""
    return S.column_profile(events(spark, sf_dir).withColumn("b", F.floor("value")), ["user_id"], ORDER, "b")


@query("""
WITH b AS (SELECT user_id, max(event_id) FILTER (event_type = 'error') AS bad FROM events GROUP BY 1)
SELECT user_id, min(event_id) AS start, count(*) AS n FROM events JOIN b USING (user_id) WHERE bad IS NULL OR event_id > bad GROUP BY 1""")
def suffix_share(spark, sf_dir):
    """WIN15: from where on no error follows."""
    return S.clean_suffix(t(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") != "error")


@query(f"""
{_E}, l AS (SELECT event_id, moment + CAST(value AS BIGINT) * 60000000 AS "end", lead(moment) OVER {_W} AS next_begin FROM (SELECT * REPLACE (floor(value) AS value) FROM e))
SELECT event_id, next_begin, coalesce(next_begin < "end", false) AS is_cut FROM l""")
def voice_cut(spark, sf_dir):
    """WIN16: events that the next one of the same voice cuts off, a unit of value being a minute."""
    found = events(spark, sf_dir).withColumn("end", F.col("moment") + F.floor("value") * 60_000_000)
    return S.cut_by_next(found, ["user_id"], "moment", "end", ["event_id"]).select("event_id", "next_begin", "is_cut")


@query("""SELECT l_orderkey, l_partkey, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS boundary FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem)""")
def next_boundary(spark, sf_dir):
    """WIN18: each distinct offset and the next."""
    return S.next_distinct(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey", "boundary")


@query("""
WITH a AS (SELECT user_id, min(event_id) AS asked FROM events WHERE event_type = 'signup' GROUP BY 1)
SELECT a.user_id, asked, min(event_id) AS answered FROM a LEFT JOIN events e ON e.user_id = a.user_id AND event_type = 'purchase' AND event_id >= asked GROUP BY ALL""")
def sequence_match(spark, sf_dir):
    """REP2: the first purchase at or after the first signup."""
    found = t(spark, sf_dir, "events")
    return S.first_after(found.where("event_type = 'signup'"), found.where("event_type = 'purchase'"), ["user_id"], "event_id")


@query("""SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS place, event_id || ':' || event_type AS line FROM events WHERE event_type = 'error'""")
def boot_log(spark, sf_dir):
    """REP1: a user's errors as numbered lines in order."""
    errors = t(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", "event_id", "event_type")
    placed = S.numbered(errors, ["user_id"], ["event_id"], "place")
    return placed.select("user_id", "place", F.concat_ws(":", F.col("event_id").cast("string"), "event_type").alias("line"))
