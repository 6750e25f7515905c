"""Queries over commands as bytes: their frames by family, and the keys that sent bytes stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import framing as P
from corvane.plans.registry import query, t

FAMILIES = ["ZAC1370", "SPINB", "INDER", "GPSM", "GPSM3", "JVH", "GTS80", "PLAYZ", "WMSS67", "WPCS", "DCS", "BYSNT", "TABART", "BY56", "BY45", "CAPCOMS"]
_LISTED = "[" + ", ".join(f"'{f}'" for f in FAMILIES) + "]"
_FRAME = """CASE WHEN family = 'ZAC1370' THEN CASE WHEN b >= 128 THEN [b - 128, b, b - 128] ELSE [b] END WHEN family IN ('SPINB', 'INDER') THEN CASE WHEN b >= 128 THEN [b, 0] ELSE [b] END
  WHEN family = 'GPSM3' OR family = 'GPSM' AND tbl THEN [15, b % 16, b // 16, 15] WHEN family = 'GPSM' THEN CASE WHEN b % 16 = 15 THEN [b] ELSE [15, b % 16, 15] END
  WHEN family = 'JVH' AND after THEN CASE WHEN b % 64 = 63 THEN [b] ELSE [b, 63] END WHEN family = 'GTS80' THEN CASE WHEN b = 0 THEN [b] ELSE [b, 0] END
  WHEN family = 'PLAYZ' THEN CASE WHEN b // 16 % 8 = 0 THEN [b] ELSE [0, b, 0] END WHEN family = 'WMSS67' THEN CASE WHEN (b & idle) = idle THEN [b] ELSE [255, b, 255] END ELSE [b] END"""
_HEX = "array_to_string(list_transform({0}, lambda x: printf('%02X', x)), '')"


def _commands(spark, sf_dir, most):
    """Commands of one to `most` bytes from events, with a family and hints."""
    id, user = F.col("event_id"), F.col("user_id")
    q = F.expr("event_id div 16")
    data = F.array(id * 37 % 256, (q * 11 + user) % 256, q % 256).cast("array<int>")
    family = F.element_at(F.array(*map(F.lit, FAMILIES)), (id % len(FAMILIES) + 1).cast("int"))
    subtype = F.element_at(F.array(F.lit(0), F.lit(1), F.lit(4)), (id % 3 + 1).cast("int"))
    size = (user % most + 1).cast("int")
    return t(spark, sf_dir, "events").select("event_id", family.alias("family"), F.slice(data, 1, size).alias("data"), (q % 3 == 0).alias("tbl"), (q % 2 == 0).alias("after"), (q % 7 == 0).alias("control"), subtype.alias("subtype"), (q % 5 == 0).alias("strobe"))


def _hints():
    return P.Hints(*map(F.col, ("tbl", "after", "control", "subtype", "strobe")))


@query(f"""
WITH c AS (SELECT event_id, {_LISTED}[event_id % 16 + 1] AS family, event_id // 16 AS q, [event_id * 37 % 256, (event_id // 16 * 11 + user_id) % 256, event_id // 16 % 256][1:1 + user_id % 3] AS d FROM events),
h AS (SELECT *, q % 3 = 0 AS tbl, q % 2 = 0 AS after, CASE event_id % 3 WHEN 0 THEN 31 WHEN 1 THEN 127 ELSE 95 END AS idle,
  CASE WHEN family = 'DCS' AND len(d) % 2 = 1 THEN 'DCS: an odd number of bytes' WHEN family = 'WPCS' AND len(d) = 3 THEN 'WPCS: an odd number of bytes after the first' WHEN family = 'WMSS67' AND q % 7 = 0 AND list_contains(d, 128) THEN 'System 3: a pulse of the control line'
    WHEN family = 'TABART' THEN 'Tabart: the commands go through the data port' WHEN family = 'BY45' AND q % 5 = 0 THEN 'Baby Pac-Man''s board: nibbles with a strobe' WHEN family = 'BY56' THEN 'two nibbles on the same lines' END AS refused FROM c),
f AS (SELECT *, CASE WHEN family = 'WPCS' AND len(d) = 1 THEN [0] || d WHEN family = 'BYSNT' AND d = [6] THEN [6, 4] ELSE flatten(list_transform(d, lambda b: {_FRAME})) END AS sent FROM h)
SELECT event_id, family, CASE WHEN refused IS NULL AND len(sent) <= 6 THEN {_HEX.format("sent")} END AS sent, coalesce(refused, CASE WHEN len(sent) > 6 THEN 'more than the 6 bytes of an entry' END) AS reason FROM f""")
def command_frames(spark, sf_dir):
    """FN7, FN8: what a commander sends for each command, or why it cannot."""
    out = _commands(spark, sf_dir, 3).select("event_id", "family", P.commander(F.col("family"), F.col("data"), F.lit(False), _hints()).alias("c"))
    return out.select("event_id", "family", F.when(F.col("c.bytes").isNotNull(), P.hex_of(F.col("c.bytes"))).alias("sent"), "c.reason")


@query(f"""
WITH c AS (SELECT event_id, {_LISTED}[event_id % 16 + 1] AS family, event_id * 37 % 256 AS b, event_id // 16 % 3 = 0 AS tbl, event_id // 16 % 2 = 0 AS after, CASE event_id % 3 WHEN 0 THEN 31 WHEN 1 THEN 127 ELSE 95 END AS idle, event_id // 16 AS q FROM events),
every AS (SELECT family, tbl, after, idle, b, {_FRAME} AS sent FROM (SELECT DISTINCT family, tbl, after, idle FROM c), (SELECT range AS b FROM range(256))),
frames AS (SELECT * REPLACE (CASE WHEN family = 'WPCS' THEN [0, b] WHEN family = 'BYSNT' AND b = 6 THEN [6, 4] ELSE sent END AS sent) FROM every),
keys AS (SELECT family, tbl, after, idle, sent, min(b) AS least FROM frames WHERE len(sent) > 1 GROUP BY ALL)
SELECT event_id, c.family, {_HEX.format("f.sent")} AS sent, printf('%02X', coalesce(least, c.b)) AS key FROM c JOIN frames f USING (family, tbl, after, idle, b) LEFT JOIN keys k ON k.family = f.family AND k.tbl = f.tbl AND k.after = f.after AND k.idle = f.idle AND k.sent = f.sent
WHERE c.family NOT IN ('DCS', 'TABART', 'BY56') AND NOT (c.family = 'BY45' AND q % 5 = 0) AND NOT (c.family = 'WMSS67' AND q % 7 = 0 AND c.b = 128)""")
def command_keys(spark, sf_dir):
    """FN8: the key of what is sent for each command of one byte that can be sent."""
    out = _commands(spark, sf_dir, 1).withColumn("bytes", P.framed_bytes(F.col("family"), F.col("data"), _hints())).where("bytes is not null")
    return out.select("event_id", "family", P.hex_of(F.col("bytes")).alias("sent"), P.hex_of(P.key_of(F.col("bytes"), F.col("family"), F.lit(False), _hints())).alias("key"))
