"""Queries over files that are written and read again: sounds with loops, and dictionaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import gains
from corvane.plans.measured import series
from corvane.plans.registry import query, t
from corvane.session import scratch
from corvane.sources import archives, dictionaries, reports, wave


@query("""
WITH s AS (SELECT event_id // 200 AS bucket, count(*) AS n FROM events GROUP BY 1),
p AS (SELECT *, bucket % 7 AS intro, 20 + bucket % 50 * 5 AS period FROM s)
SELECT 'sound_' || bucket || '.wav' AS name, CASE WHEN intro + period <= n THEN CAST(intro + period * greatest(1, ceil((1000 - intro) / period)) AS BIGINT) ELSE n END AS frames,
  CASE WHEN intro + period <= n THEN intro END AS loop_start, CASE WHEN intro + period <= n THEN intro + period - 1 END AS loop_end FROM p""")
def sound_files(spark, sf_dir):
    """SNK10, K20: sounds whose loops are extended, as files with loop points, read again."""
    cents = F.greatest(F.least((F.col("value") * 100 - 8000).cast("int"), F.lit(32000)), F.lit(-32000))
    word = F.conv(F.pmod(cents, F.lit(65536)).cast("string"), 10, 16)
    word = F.lpad(word, 4, "0")
    rows = t(spark, sf_dir, "events").select(F.expr("event_id div 200").alias("bucket"), F.struct("event_id", F.concat(F.right(word, F.lit(2)), F.left(word, F.lit(2))).alias("v")).alias("e"))
    sounds = rows.groupBy("bucket").agg(F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["v"]), "")).alias("pcm"))
    bucket = F.col("bucket")
    sounds = sounds.select(F.concat(F.lit("sound_"), bucket.cast("string"), F.lit(".wav")).alias("name"), "pcm", F.lit(1).alias("channels"), (bucket % 7).alias("intro"), (20 + bucket % 50 * 5).alias("period"))
    folder = scratch(spark, "waves")
    wave.write_waves(wave.extended(sounds, F.lit(1000)).select("name", "channels", "pcm", "loop_start", "loop_end"), folder)
    found = archives.files(spark, folder, "*.wav")
    read = archives.wav_sounds(found).select("path", "frames").join(wave.loops(found), "path")
    return read.select(X.base_name(F.col("path")).alias("name"), "frames", "loop_start", "loop_end")


@query()
def dithered_gains(spark, sf_dir):
    """Sounds scaled back to 16 bits with a dither that their names seed."""
    name = F.concat(F.format_string("0x%04X", "bucket"), F.lit(".wav"))
    sounds = series(spark, sf_dir, 12, 8).select("bucket", name.alias("name"), "pcm", (F.lit(0.5) + F.col("bucket") % 9 / 4).alias("gain"))
    return gains.scaled(sounds).select("bucket", "name", "clamped", F.crc32("pcm").alias("crc"), F.length("pcm").alias("n_bytes"))


@query("""
WITH n AS (SELECT replace(lower(n_name), ' ', '_') || ':' AS heading, n_nationkey FROM nation),
e AS (SELECT heading, printf('%06x', s_suppkey) AS key, repeat(s_name || ' ', 1 + s_suppkey % 6) AS name FROM supplier JOIN n ON s_nationkey = n_nationkey)
SELECT heading, key, left(CASE WHEN length(name) > 90 THEN rtrim(left(name, 90)) ELSE name END, 29) AS name FROM e""")
def dictionary_round_trip(spark, sf_dir):
    """SRC17, SNK7: dictionaries with filled comments, written and read back by their exact reader."""
    heading = F.replace(F.lower("n_name"), F.lit(" "), F.lit("_"))
    nations = t(spark, sf_dir, "nation").select("n_nationkey", heading.alias("heading"), F.repeat(F.concat("n_name", F.lit(" ")), F.lit(20)).alias("comment"))
    supplier = t(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    entries = supplier.select("heading", F.format_string("%06x", "s_suppkey").alias("key"), F.repeat(F.concat("s_name", F.lit(" ")), (1 + F.col("s_suppkey") % 6).cast("int")).alias("name"))
    lines = dictionaries.dictionary_text(nations, entries)
    text = lines.groupBy(F.col("heading").alias("path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "value"))), lambda x: x["value"]), "\n").alias("text"))
    found = dictionaries.exact_entries(dictionaries.buffered_lines(text))
    games = nations.select(F.concat("heading", F.lit(":")).alias("game"), F.lit(None).cast("string").alias("parent"))
    return dictionaries.listed(found, games).select("heading", "key", "name")


@query("""
WITH o AS (SELECT *, o_orderkey % 3 AS place, 'f' || (o_custkey % 40) AS folder, CASE WHEN o_orderkey % 2 = 0 THEN 'manifest' ELSE 'boot' END AS kind FROM orders),
f AS (SELECT place, folder, kind, max(o_orderkey) AS k FROM o GROUP BY ALL),
r AS (SELECT place, folder, max(k) FILTER (kind = 'manifest') AS m, max(k) FILTER (kind = 'boot') AS b FROM f GROUP BY ALL),
n AS (SELECT *, CASE WHEN coalesce(m, b) % 7 = 0 THEN folder ELSE 's' || (coalesce(m, b) % 50) END AS set FROM r),
l AS (SELECT set, arg_max(m, (place, folder)) FILTER (m IS NOT NULL) AS m, arg_max(b, (place, folder)) FILTER (b IS NOT NULL) AS b FROM n GROUP BY set)
SELECT set, m AS manifest, b AS boot, CASE m % 8 WHEN 0 THEN '0:SAM:E' || (m % 10) || 'E8' WHEN 2 THEN '0:SAM:E' || (m % 10) WHEN 4 THEN '0:B:02,1:A:01' WHEN 6 THEN '' END AS volumes FROM l""")
def run_reports(spark, sf_dir):
    """SRC11, PRJ17: the last report of each kind of each set, and the volumes in it."""
    key = F.col("k")
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 3).alias("place"), F.concat(F.lit("f"), (F.col("o_custkey") % 40).cast("string")).alias("folder"), F.when(F.col("o_orderkey") % 2 == 0, "manifest").otherwise("boot").alias("kind"))
    files = orders.groupBy("place", "folder", "kind").agg(F.max("k").alias("k"))
    rom = F.when(key % 7 > 0, F.format_string('"rom": "s%d", ', key % 50)).otherwise("")
    commands = '"factory_volume": {"commands": [{"kind": "master", "board": 1, "family": "X", "bytes": "00"}, {"kind": "master", "family": "B", "bytes": "02"}, {"kind": "mixer", "board": 2}, {"kind": "master", "board": 1, "family": "A", "bytes": "01"}]}'
    shape = F.when(key % 8 == 0, F.format_string('"factory_offset": {"factory_volume": "E%d E8"}', key % 10)).when(key % 8 == 2, F.format_string('"factory_volume": {"attenuation": {"left": "E%d"}}', key % 10)).when(key % 8 == 4, commands).otherwise('"factory_volume": {"commands": []}')
    texts = files.select("place", "folder", "kind", F.concat(F.lit("{"), rom, shape, F.format_string(', "k": %d}', key)).alias("value"))
    volumes = F.transform(reports.factory_volumes(F.col("manifest")), lambda v: F.concat_ws(":", v["board"].cast("string"), v["family"], v["bytes"]))
    number = lambda c: F.get_json_object(c, "$.k").cast("long")
    found = reports.runs(texts).withColumn("volumes", F.array_join(volumes, ","))
    return found.withColumns({"manifest": number("manifest"), "boot": number("boot")}).drop("bad")
