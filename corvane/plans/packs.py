"""Queries of packs: rows, gains, volumes, summaries and their lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.functions import rules as R
from corvane.operators import packs as P
from corvane.operators.grouping import median
from corvane.plans.registry import query, t
from corvane.sources import sinks, texts

_ROWS = """
WITH r AS (SELECT p_partkey AS id, p_brand, p_name, ['music', 'callout', 'sfx'][p_size % 3 + 1] AS kind, p_size % 5 = 0 AS looped, p_size % 7 = 0 AS continuous, ['voice', 'fm'][p_partkey % 2 + 1] AS chip,
  CASE WHEN p_partkey % 3 > 0 THEN -(p_partkey % 12) END AS ducks_db, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 5 = 0 END AS stops, CASE WHEN p_partkey % 6 > 0 THEN p_name ELSE ' ' END AS name FROM part),
b AS (SELECT *, stops IS NOT NULL AND NOT (kind = 'music' AND (looped OR continuous)) AS able FROM r),
c AS (SELECT *, able AND chip = 'voice' AS voice, able AND coalesce(stops, false) AS stopping, CASE WHEN kind = 'music' AND (looped OR continuous) THEN 'MUSIC' WHEN kind = 'callout' THEN 'CALLOUT' ELSE 'SFX' END AS plain FROM b),
w AS (SELECT id, p_brand, kind, CASE WHEN voice AND (kind <> 'sfx' OR trim(name) = '') THEN 'CALLOUT' ELSE plain END AS gtype,
  CASE WHEN able AND ducks_db IS NOT NULL THEN CAST(least(greatest(floor(100 * pow(10.0, ducks_db / 20.0) + 0.5), 0), 100) AS INTEGER) ELSE 100 END AS duck, voice AND stopping AS stop,
  CASE WHEN voice THEN 1 WHEN stopping THEN 0 WHEN kind = 'music' THEN 0 ELSE -1 END AS channel FROM c)"""


def rows_of(spark, sf_dir):
    key = F.col("p_partkey")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    rows = t(spark, sf_dir, "part").select(
        key.alias("id"), "p_brand", pick(("music", "callout", "sfx"), F.col("p_size") % 3).alias("kind"), (F.col("p_size") % 5 == 0).alias("looped"), (F.col("p_size") % 7 == 0).alias("continuous"),
        pick(("voice", "fm"), key % 2).alias("chip"), F.when(key % 3 > 0, -(key % 12)).alias("ducks_db"), F.when(key % 4 > 0, key % 5 == 0).alias("stops"), F.when(key % 6 > 0, F.col("p_name")).otherwise(" ").alias("name"))
    return P.chip_rows(P.plain_rows(rows))


@query(_ROWS + " SELECT * FROM w")
def chip_rows(spark, sf_dir):
    """UPS7, PRJ4: channel, type, duck and stop of each row, from what was heard of the chips."""
    return rows_of(spark, sf_dir).select("id", "p_brand", "kind", "gtype", "duck", "stop", "channel")


@query(_ROWS + """
SELECT p_brand, count(*) FILTER (channel = 1) AS voices, count(*) FILTER (duck < 100) AS ducking, count(*) FILTER (stop) AS stopping, count(*) FILTER (channel = 0 AND kind <> 'music') AS on_music,
  coalesce(array_to_string(list_reverse_sort(list(DISTINCT duck) FILTER (duck < 100)), ','), '') AS duck_values FROM w GROUP BY 1""")
def pack_totals(spark, sf_dir):
    """AGG27, AGG36: what the rows of a pack do, and their different ducks."""
    return P.pack_totals(rows_of(spark, sf_dir), ["p_brand"]).withColumn("duck_values", F.array_join(F.col("duck_values").cast("array<string>"), ","))


@query(_ROWS + """, p AS (SELECT gtype, duck, dense_rank() OVER (PARTITION BY gtype ORDER BY duck DESC) AS profile FROM (SELECT DISTINCT gtype, duck FROM w WHERE gtype <> 'MUSIC' AND duck < 100))
SELECT id, printf('0x%04X', id) || ',' || gtype || ',100,' || coalesce(profile, 0) || ',f' || id || '.wav' AS value FROM w LEFT JOIN p USING (gtype, duck) UNION ALL SELECT -1, 'ID,TYPE,GAIN,DUCKING_PROFILE,FNAME'""")
def gsound_lines(spark, sf_dir):
    """SNK2: the second pack format, its header and its lines."""
    rows = rows_of(spark, sf_dir).select("id", "gtype", "duck", F.concat(F.lit("f"), F.col("id").cast("string"), F.lit(".wav")).alias("fname"))
    return sinks.gsound_lines(rows)


@query("""
WITH f AS (SELECT l_orderkey, l_suppkey, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
g AS (SELECT l_orderkey, l_suppkey, CASE WHEN l_suppkey % 4 = 0 THEN 0.0 WHEN l_orderkey % 5 = 0 THEN CASE WHEN l_orderkey % 2 = 0 THEN -3.0 ELSE 0.0 END ELSE -(l_suppkey % 7) * 1.5 END AS gain_db, l_orderkey % 5 = 0 AS moved_alone FROM f)
SELECT l_orderkey, l_suppkey, CAST(gain_db AS DOUBLE) AS gain_db, round(pow(10.0, gain_db / 20), 6) AS factor, moved_alone FROM g""")
def file_gains(spark, sf_dir):
    """J21, VOL3: the gain of each file: its own, its board's, or none."""
    files = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    boards = files.select("l_suppkey").distinct().select("l_suppkey", F.when(F.col("l_suppkey") % 4 > 0, -(F.col("l_suppkey") % 7) * 1.5).alias("gain_db"))
    own = files.select("l_orderkey").distinct().where("l_orderkey % 5 = 0").select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, -3.0).alias("gain_db"))
    out = P.file_gains(files, boards, own, "l_suppkey", "l_orderkey")
    return out.select("l_orderkey", "l_suppkey", "gain_db", F.round("factor", 6).alias("factor"), "moved_alone")


@query("""
WITH b AS (SELECT n_regionkey, n_nationkey, printf('%04X', n_nationkey * 7) AS recorded_at, printf('%04X', CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 7 ELSE n_nationkey END) AS written_at, CASE WHEN n_nationkey % 4 > 0 THEN -n_nationkey / 4.0 END AS g FROM nation)
SELECT n_regionkey, string_agg('board ' || n_nationkey || ' ' || CASE WHEN g IS NULL THEN 'reference ' || recorded_at || ' (not scaled)' ELSE 'factory ' || written_at || ' (from reference ' || recorded_at || ', ' || printf('%+.2f', CAST(g AS DOUBLE)) || ' dB)' END, ' ' ORDER BY n_nationkey) AS label
FROM b WHERE recorded_at <> written_at OR g IS NULL GROUP BY 1""")
def gain_labels(spark, sf_dir):
    """VOL3: what was done to the volume of each board."""
    key = F.col("n_nationkey")
    code = lambda x: F.format_string("%04X", x)
    boards = t(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", code(key * 7).alias("recorded_at"), code(F.when(key % 3 == 0, key * 7).otherwise(key)).alias("written_at"), F.when(key % 4 > 0, -key / 4.0).alias("gain_db"))
    return P.gain_labels(boards, "n_regionkey", "n_nationkey")


@query("""
WITH seen AS (SELECT DISTINCT n_regionkey FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_acctbal > 9000)
SELECT n_regionkey, s.n_regionkey IS NOT NULL AS seen, CASE WHEN s.n_regionkey IS NULL THEN string_agg('board ' || n_nationkey || ' (' || n_name || '): ' || CASE WHEN n_nationkey % 2 = 0 THEN 'no register' ELSE 'no volume command is known' END, '; ' ORDER BY n_nationkey) END AS note
FROM nation n LEFT JOIN seen s USING (n_regionkey) GROUP BY n_regionkey, s.n_regionkey""")
def volume_notes(spark, sf_dir):
    """PRJ24, PRJ10: whether a volume was seen, or why not."""
    nation = t(spark, sf_dir, "nation")
    boards = nation.select("n_regionkey", "n_nationkey", F.col("n_name").alias("family"), F.when(F.col("n_nationkey") % 2 == 0, "no register").alias("reason"))
    commands = t(spark, sf_dir, "supplier").where("s_acctbal > 9000").join(nation.select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey"), "s_nationkey").select("n_regionkey", F.lit("master").alias("kind"))
    return P.volume_notes(boards, commands, "n_regionkey", "n_nationkey")


@query("""
WITH c AS (SELECT user_id, value FROM events WHERE event_id % 4 > 0 AND event_type <> 'error' AND event_id % 9 > 0 AND event_id % 5 > 0), m AS (SELECT user_id, count(*) AS n, median(value) AS m FROM c GROUP BY 1)
SELECT user_id, n, sign(m) * floor(abs(m) * 1000 + 0.5) / 1000 AS median FROM m""")
def counted_median(spark, sf_dir):
    """PRJ14: the median of the files that count in totals, loops aside."""
    key = F.col("event_id")
    rows = t(spark, sf_dir, "events").select("user_id", F.when(key % 4 > 0, key).alias("file"), F.when(F.col("event_type") != "error", F.col("value")).alias("lufs"), (key % 9 == 0).alias("ignores_volume"), (key % 5 == 0).alias("loops"))
    return median(rows.where(P.counted(False)), ["user_id"], "lufs").select("user_id", "n", "median")


_PROGRAMS = """
WITH p AS (SELECT l_suppkey, l_orderkey * 8 + l_linenumber AS id, max(l_partkey) AS k FROM lineitem GROUP BY ALL),
g AS (SELECT l_suppkey, id, CASE WHEN k % 9 = 0 THEN 2 ELSE 1 END AS type, k % 4 AS channel, CASE WHEN k % 5 > 0 THEN [CAST(k % 4 AS BIGINT)] ELSE [] END AS streams, CASE WHEN k % 3 = 0 THEN -CAST(k % 40 AS DOUBLE) END AS units,
  CASE WHEN k % 7 = 0 THEN [CAST(0 AS BIGINT)] WHEN k % 7 = 1 THEN [CAST(2 AS BIGINT), CAST(3 AS BIGINT)] ELSE [] END AS stops, CASE WHEN k % 11 = 0 THEN 'x' END AS error, k FROM p)"""


def programs(spark, sf_dir):
    """Programs of track commands, a game's being a supplier's."""
    lines = t(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(F.max("l_partkey").alias("k"))
    k, none = F.col("k"), F.array().cast("array<bigint>")
    number = lambda *x: F.array(*[F.lit(v).cast("long") for v in x])
    ducks = F.when(k % 3 == 0, F.array(F.struct(F.lit(1).cast("long").alias("channel"), F.lit(-50.0).alias("units")), F.struct(F.lit(0).cast("long").alias("channel"), (-(k % 40).cast("double")).alias("units")))).otherwise(F.array().cast("array<struct<channel:bigint,units:double>>"))
    return lines.select("l_suppkey", "id", F.when(k % 9 == 0, 2).otherwise(1).alias("type"), (k % 4).alias("channel"), F.when(k % 5 > 0, F.array(k % 4)).otherwise(none).alias("streams"), ducks.alias("ducks"), F.when(k % 7 == 0, number(0)).when(k % 7 == 1, number(2, 3)).otherwise(none).alias("stops"), F.when(k % 11 == 0, "x").alias("error"), "k")


@query(_PROGRAMS + " SELECT l_suppkey, channel, count(*) AS tracks, count(*) FILTER (len(streams) > 0) AS with_stream, count(*) FILTER (units < 0) AS ducking FROM g WHERE type = 1 GROUP BY ALL")
def channel_summary(spark, sf_dir):
    """AGG28: what plays on each channel of a game, and how much of it lowers the music."""
    return P.channel_summary(programs(spark, sf_dir), "l_suppkey")


@query(_PROGRAMS + """
SELECT l_suppkey, id, 'stop' AS list, array_to_string(stops, ',') AS channels, CASE WHEN id = 99 THEN 'built in' WHEN list_contains(stops, 0) THEN 'lost: only one id stops the music' ELSE 'lost: a voice or an effect cannot be stopped' END AS note FROM g WHERE len(streams) = 0 AND len(stops) > 0
UNION ALL SELECT l_suppkey, id, 'deferred', CAST(channel AS VARCHAR), NULL FROM g WHERE type = 2 UNION ALL SELECT l_suppkey, id, 'unreadable', NULL, NULL FROM g WHERE error IS NOT NULL""")
def program_lists(spark, sf_dir):
    """AGG28: programs that only stop, that wait, and that could not be read."""
    return P.program_lists(programs(spark, sf_dir), "l_suppkey", 99).withColumn("channels", F.array_join(F.col("channels").cast("array<string>"), ","))


@query(_PROGRAMS + """,
m AS (SELECT *, type = 1 AND channel = 0 AND list_contains(streams, 0) AS music, channel = l_suppkey % 4 AND l_suppkey % 5 > 0 AS of_voice, error IS NULL AND id % 13 > 0 AS known, k % 2 = 0 AS looped FROM g)
SELECT l_suppkey, id, CASE WHEN NOT known THEN CASE WHEN id % 3 = 0 THEN 0 ELSE -1 END WHEN music THEN 0 WHEN of_voice THEN 1 ELSE -1 END AS channel,
  CASE WHEN NOT known OR music OR units IS NULL THEN 100 ELSE CAST(least(greatest(floor(100 * pow(0.9733, -units) + 0.5), 0), 100) AS INTEGER) END AS duck,
  CASE WHEN NOT known THEN CASE WHEN id % 3 = 0 AND looped THEN 'MUSIC' ELSE 'SFX' END WHEN music THEN CASE WHEN looped THEN 'MUSIC' ELSE 'SFX' END WHEN of_voice THEN 'CALLOUT' ELSE 'SFX' END AS gtype,
  known AND NOT music AND of_voice AND list_contains(stops, 0) AS stop, known AND NOT music AND NOT of_voice AND list_contains(stops, 0) AS lost_stop FROM m""")
def program_rows(spark, sf_dir):
    """UPS7: channel, type, duck and stop of each row, from what its program does; and the stops that are lost."""
    found = programs(spark, sf_dir)
    key = F.col("id")
    rows = P.plain_rows(found.select("l_suppkey", "id", F.when(key % 3 == 0, "music").otherwise("sfx").alias("kind"), (F.col("k") % 2 == 0).alias("looped"), F.lit(False).alias("continuous")))
    voices = found.select("l_suppkey").distinct().where("l_suppkey % 5 > 0").select("l_suppkey", (F.col("l_suppkey") % 4).alias("voice"))
    out = P.program_rows(rows, found.where("id % 13 > 0"), voices, "l_suppkey")
    return out.select("l_suppkey", "id", "channel", "duck", "gtype", "stop", "lost_stop")


@query(_PROGRAMS + """
SELECT l_suppkey, string_agg('0x' || printf('%04X', id), ' ' ORDER BY id) AS lost FROM g
WHERE error IS NULL AND list_contains(stops, 0) AND NOT (type = 1 AND channel = 0 AND list_contains(streams, 0)) AND channel <> l_suppkey % 4 GROUP BY l_suppkey""")
def lost_stops(spark, sf_dir):
    """UPS7: the commands of each game whose stop the player cannot do."""
    found = programs(spark, sf_dir)
    rows = P.plain_rows(found.select("l_suppkey", "id", F.lit("sfx").alias("kind"), F.lit(False).alias("looped"), F.lit(False).alias("continuous")))
    voices = found.select("l_suppkey", (F.col("l_suppkey") % 4).alias("voice")).distinct()
    return P.pack_limits(P.program_rows(rows, found, voices, "l_suppkey"), "l_suppkey")



@query("""
WITH l AS (SELECT o_custkey, o_orderstatus AS role, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS sample FROM orders GROUP BY ALL)
SELECT o_custkey, string_agg(role || '=' || sample, ' ' ORDER BY role) AS roles FROM l GROUP BY 1""")
def song_roles(spark, sf_dir):
    """AGG31: the sample of each role of a song; the last one stands."""
    samples = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("role"), F.struct("o_totalprice", "o_orderkey").alias("ord"), F.col("o_orderkey").alias("sample"))
    roles = F.transform(F.array_sort(F.map_entries("roles")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return P.song_roles(samples, "o_custkey").select("o_custkey", F.array_join(roles, " ").alias("roles"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_size % 3 = 1 THEN 'A+B' WHEN p_size % 4 = 0 THEN 'A' WHEN p_size % 4 = 1 AND p_size % 3 = 2 THEN 'C' ELSE 'NONE' END AS boards FROM part""")
def board_choice(spark, sf_dir):
    """PRJ8: the boards of a machine by its initialiser and generation."""
    table = spark.createDataFrame([(0, 1, 1, "A"), (0, 1, 2, "B"), (0, None, 1, "A"), (1, 2, 1, "C")], "init int, generation int, place int, board string")
    machines = t(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 4).alias("init"), (F.col("p_size") % 3).alias("generation"))
    return P.boards_of(machines, table, "NONE").select("p_partkey", "boards")


@query("""
SELECT l_suppkey AS set, 'p' || (l_partkey % 100) AS name, l_linenumber AS crc, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS region, bool_or(l_quantity > 45) AS sound FROM lineitem GROUP BY ALL""")
def merged_files(spark, sf_dir):
    """SRC6: files that are loaded into several regions, once."""
    name = F.concat(F.when(F.col("l_partkey") % 2 == 0, "P").otherwise("p"), (F.col("l_partkey") % 100).cast("string"))
    return P.merged_files(t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("set"), name.alias("name"), F.col("l_linenumber").alias("crc"), F.col("l_returnflag").alias("region"), (F.col("l_quantity") > 45).alias("sound")))


@query("""
WITH s AS (SELECT p_partkey, p_retailprice / 100 AS seconds, p_size / 8.0 AS period, p_size FROM part),
c AS (SELECT *, least(greatest(period * 4, 20), 60) AS need FROM s)
SELECT p_partkey, need, seconds + period * 4 + need + 2 AS ready, seconds + period * 4 + need + 2 <= 60 AS usable, [CASE WHEN p_size % 8 = 0 THEN 1 WHEN p_size % 4 = 0 THEN 2 WHEN p_size % 2 = 0 THEN 4 ELSE 8 END][1] AS cycles FROM c""")
def loop_plans(spark, sf_dir):
    """SEL6, K11: how long a loop has to be heard, and how many cycles are a whole number of frames."""
    period = F.col("p_size") / 8.0
    found = t(spark, sf_dir, "part").select("p_partkey", P.search_cap(F.col("p_retailprice") / 100, period * 4, longest=60.0).alias("s"), P.whole_cycles(period, 16, 0.05).alias("cycles"))
    return found.select("p_partkey", "s.need", "s.ready", "s.usable", "cycles")


@query("""
SELECT p_partkey, concat_ws('; ', 'no exact repetition within ' || printf('%.0f', round_even(p_retailprice / 10, 0)) || ' s (the period must hold over two cycles and at least 20 s)', CASE WHEN p_size % 3 = 0 THEN 'the state repeats' END,
  CASE WHEN p_size % 4 = 0 AND p_size % 5 > 0 THEN 'the program repeats every ' || printf('%.3f', p_size / 8.0) || ' s, which the audio did not confirm' WHEN p_size % 4 = 1 THEN 'the program ends after ' || printf('%.3f', p_size / 4.0) || ' s'
    WHEN p_size % 4 IN (0, 2) AND p_size % 7 = 0 THEN 'program: unknown opcode' END) || CASE WHEN p_size % 4 = 0 AND p_size % 7 = 0 THEN ' (unknown opcode)' ELSE '' END AS reason FROM part""")
def unresolved_reasons(spark, sf_dir):
    """REP3: why a sound that went on has no loop."""
    size = F.col("p_size")
    program = F.when(size % 4 == 0, "loops").when(size % 4 == 1, "ends").when(size % 4 == 2, "unknown")
    reason = P.unresolved_reason(F.col("p_retailprice") / 10, F.when(size % 3 == 0, "the state repeats"), program, F.when(size % 5 > 0, size / 8.0), size / 4.0, F.when(size % 7 == 0, "unknown opcode"))
    return t(spark, sf_dir, "part").select("p_partkey", reason.alias("reason"))


@query("""
WITH d AS (SELECT doc_id, n_chars * n_chars AS n FROM documents)
SELECT doc_id, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN CASE WHEN n % 1024 = 0 THEN CAST(n // 1024 AS VARCHAR) ELSE printf('%.1f', floor(n / 1024.0 * 10 + 0.5) / 10) END || ' KiB'
    ELSE CASE WHEN n % 1048576 = 0 THEN CAST(n // 1048576 AS VARCHAR) ELSE printf('%.2f', floor(n / 1048576.0 * 100 + 0.5) / 100) END || ' MiB' END AS size, format('{:,}', n) AS digits,
  upper(CASE WHEN len(printf('%x', doc_id)) % 2 = 1 THEN '0' ELSE '' END || printf('%x', doc_id)) AS bytes, CASE WHEN len(printf('%x', doc_id)) % 2 = 0 THEN printf('%X', doc_id) END AS strict,
  CASE WHEN doc_id % 65536 BETWEEN 16384 AND 32767 THEN doc_id % 7 * 16384 + doc_id % 65536 - 16384 END AS place, doc_id % 5 * 65536 + doc_id % 256 * 256 + doc_id % 3 AS pointer FROM d""")
def small_formats(spark, sf_dir):
    """FN17, FN2, FN18: sizes, byte lists and pointers."""
    key = F.col("doc_id")
    text = F.concat(F.lit("0x"), F.format_string("%x", key))
    return t(spark, sf_dir, "documents").select(
        "doc_id", P.human_bytes(F.col("n_chars") * F.col("n_chars")).alias("size"), P.grouped_digits(F.col("n_chars") * F.col("n_chars")).alias("digits"), P.byte_list(text).alias("bytes"), P.byte_list(text, True).alias("strict"),
        P.banked(key % 7, key % 65536).alias("place"), P.pointer24(key % 5, key % 256, key % 3).alias("pointer"))


@query("""
SELECT n_nationkey, '{"key":' || n_nationkey || ',"label":"' || n_name || '","sets":[' || coalesce(string_agg('{"set":' || s_suppkey || ',"name":"' || s_name || '"}', ',' ORDER BY s_suppkey), '') || ']}' AS value
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def catalogue_lines(spark, sf_dir):
    """SNK5, SNK4, REP5: each entry with its sets as a line of JSON."""
    sets = t(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("set"), F.col("s_name").alias("name")))).alias("sets"))
    entries = t(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("key"), F.col("n_name").alias("label")).join(sets, "n_nationkey", "left")
    return sinks.entry_lines(entries, "n_nationkey", ["key", "label", "sets"])


@query("""
SELECT o_orderkey, plan, plan || '.txt' AS file, 'o' || o_orderkey AS value FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'measure' WHEN o_orderpriority LIKE '1%' THEN 'boot' ELSE 'differs' END AS plan FROM orders)""")
def plan_lines(spark, sf_dir):
    """SNK14: the lines of each plan's file."""
    plan = F.when(F.col("o_orderstatus") == "O", "measure").when(F.col("o_orderpriority").startswith("1"), "boot").otherwise("differs")
    orders = t(spark, sf_dir, "orders").select("o_orderkey", plan.alias("plan"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"))
    return sinks.plan_lines(orders).select("o_orderkey", "plan", "file", "value")


@query(r"""
SELECT p_partkey, printf('0x%04X', p_partkey) || ',f.wav,' || p_size || ',' || trim(regexp_replace(n, '[^A-Za-z0-9 _.()+-]', '_', 'g')) || ',' || printf('%.2f', CAST(floor(p_retailprice) / 4 AS DOUBLE)) || ',' || CASE WHEN p_size % 2 = 0 THEN '0.50' ELSE '' END AS value
FROM (SELECT *, p_name || CASE WHEN p_size % 3 = 0 THEN ', "take" #' || p_size ELSE '.wav ' END AS n FROM part)""")
def replacement_lines(spark, sf_dir):
    """SNK9: the lines of a record of replaced files, sources as plain names, figures with two decimals, unknown ones empty."""
    source = F.concat(F.lit("C:\\my/"), "p_name", F.when(F.col("p_size") % 3 == 0, F.concat(F.lit(', "take" #'), F.col("p_size").cast("string"))).otherwise(".wav "))
    rows = t(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").alias("id"), F.lit("f.wav").alias("fname"), F.col("p_size").alias("gain"), source.alias("source"), (F.floor("p_retailprice") / 4).alias("lufs"), F.when(F.col("p_size") % 2 == 0, 0.5).alias("offset"))
    return sinks.replacement_lines(rows, "p_partkey")


@query("""
WITH e AS (SELECT event_id, 'k' || k AS key, 'a/' || k || '.md' AS v FROM (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))
SELECT event_id, key, v AS path FROM e WHERE key LIKE 'k1%' AND NOT contains(v, '9')""")
def map_entries(spark, sf_dir):
    """SRC9: entries of JSON maps, by key prefix, without paths that lead outside."""
    number = F.get_json_object("props", "$.k")
    text = F.format_string('{"k%s": "./a/%s.md", "x": 3}', number, F.when(F.contains(number, F.lit("9")), F.lit("..")).otherwise(number))
    rows = t(spark, sf_dir, "events").select("event_id", text.alias("text"))
    return texts.json_map(rows, "text", "k1").select("event_id", "key", F.col("value").alias("path"))


@query("SELECT s_suppkey, '0x' || printf('%04X', s_suppkey) AS id_text, s_suppkey AS parsed FROM supplier")
def id_round_trip(spark, sf_dir):
    """FN1: an id as text and back."""
    text = X.id_text(F.col("s_suppkey"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", text.alias("id_text"), X.parse_id(text).alias("parsed"))


SILENT = ["DCS", "WPCS", "AT91", "BSMT (Data East)", "WMSS11C", "BY45", "BYSNT", "BY32", "GTS80"]


@query("""
SELECT c_custkey, family, CASE WHEN family IN ('WMSS11C', 'BY45', 'BY32', 'BSMT (Data East)') THEN 'full_scale (no volume stage)' WHEN family = 'BYSNT' THEN 'full_scale (volume lines not emulated in PinMAME)' END AS plays_at,
  CASE family WHEN 'DCS' THEN 'the game sent no 55 AA vv ~vv during boot (the board keeps its reset default, 67)' WHEN 'WPCS' THEN 'the game sent no 79 vv ~vv during boot' WHEN 'AT91' THEN 'no FE 10..2F seen (Whitestar''s master volume command)'
    WHEN 'BSMT (Data East)' THEN 'Data East sets the master volume with a hardware pot' WHEN 'WMSS11C' THEN 'System 11 sound boards have no volume stage' WHEN 'BY45' THEN 'Cheap Squeak boards have no volume stage'
    WHEN 'BYSNT' THEN 'the Squawk & Talk''s volume lines are not emulated in PinMAME (its commands DF..FE)' WHEN 'BY32' THEN 'the early Bally sound boards have no volume stage' ELSE 'no known volume command for this board family' END AS reason
FROM (SELECT c_custkey, ['DCS', 'WPCS', 'AT91', 'BSMT (Data East)', 'WMSS11C', 'BY45', 'BYSNT', 'BY32', 'GTS80'][c_custkey % 9 + 1] AS family FROM customer)""")
def silent_boards(spark, sf_dir):
    """PRJ10: what boards without a reported volume play at, and why they report none."""
    family = F.element_at(F.array(*map(F.lit, SILENT)), (F.col("c_custkey") % len(SILENT) + 1).cast("int"))
    rows = t(spark, sf_dir, "customer").select("c_custkey", family.alias("family"))
    return rows.withColumns({"plays_at": R.full_scale(F.col("family")), "reason": R.no_volume_reason(F.col("family"))})


@query("""
WITH p AS (SELECT p_partkey, p_retailprice / 10.0 AS intro, p_size * 10.0 AS period, p_size % 4 > 0 AS loops FROM part),
r AS (SELECT *, intro + period + least(greatest(period, 20), 60) + 2 AS ready FROM p)
SELECT p_partkey, CAST(CASE WHEN loops AND ready <= 300 THEN greatest(120, ready + 5) ELSE 120 END AS DOUBLE) AS cap, CAST(CASE WHEN loops AND ready <= 300 THEN period END AS DOUBLE) AS hint, CASE WHEN loops AND ready > 300 THEN 'too long to confirm' END AS reason FROM r""")
def search_caps(spark, sf_dir):
    """SEL6: how long each sound is recorded, and the period to look for, by what its program says."""
    size = F.col("p_size")
    plan = F.when(size % 4 > 0, P.search_cap(F.col("p_retailprice") / 10.0, size * 10.0, longest=300.0))
    return t(spark, sf_dir, "part").select("p_partkey", P.recorded_until(F.lit(120.0), plan, size * 10.0).alias("r")).select("p_partkey", "r.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_returnflag <> 'N' AND l_quantity % 2 = 0""")
def required_files(spark, sf_dir):
    """PRJ1: the files that a complete set must hold."""
    from corvane.operators.matching import required

    crc = F.when(F.col("l_quantity") % 2 == 0, F.col("l_partkey"))
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_returnflag") == "N").alias("no_dump"), crc.alias("crc"))
    return required(rows).select("l_orderkey", "l_linenumber", "l_partkey")
