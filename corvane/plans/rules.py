"""Queries of rules and reconciliation: what a row is called, what it is, and what two lists make of each other."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.functions import rules as R
from corvane.operators import reconcile as C
from corvane.operators.grouping import best_by, top_with_remainder
from corvane.plans.catalogue import rounded_sql
from corvane.plans.ordered import events
from corvane.plans.registry import query, t

_SOUND = """
s AS (SELECT p_partkey, p_retailprice / 100 AS seconds, p_size % 7 = 0 AS playing, CASE WHEN p_size % 2 = 0 THEN 'callout' END AS heard,
  CASE p_partkey % 4 WHEN 0 THEN 'loop' WHEN 1 THEN 'max' WHEN 2 THEN 'silence' ELSE 'no_sound' END AS ended_by,
  CASE p_size % 5 WHEN 0 THEN ' Music: ' || p_name WHEN 1 THEN '"' || p_name || '"' WHEN 2 THEN 'VOX: ' || p_name WHEN 3 THEN 'sfx: ' || p_name ELSE p_name END AS name FROM part)"""


def sounds(spark, sf_dir):
    name = F.col("p_name")
    marked = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(" Music: "), name)).when(F.col("p_size") % 5 == 1, F.concat(F.lit('"'), name, F.lit('"')))
    marked = marked.when(F.col("p_size") % 5 == 2, F.concat(F.lit("VOX: "), name)).when(F.col("p_size") % 5 == 3, F.concat(F.lit("sfx: "), name)).otherwise(name)
    ends = F.element_at(F.array(*map(F.lit, ("loop", "max", "silence", "no_sound"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / 100).alias("seconds"), (F.col("p_size") % 7 == 0).alias("playing"), F.when(F.col("p_size") % 2 == 0, "callout").alias("heard"), ends.alias("ended_by"), marked.alias("name"))


@query(f"""
WITH {_SOUND},
k AS (SELECT *, lower(ltrim(name)) AS low FROM s)
SELECT p_partkey, CASE WHEN playing OR starts_with(low, 'music:') THEN 'music' WHEN low[1] = '"' OR starts_with(low, 'vox:') OR starts_with(low, 'voice:') THEN 'callout'
    WHEN starts_with(low, 'sfx:') THEN 'sfx' ELSE coalesce(heard, 'sfx') END AS kind,
  CASE WHEN playing AND p_partkey % 3 = 0 THEN 'intro-loop-extended' WHEN playing THEN 'body-loop' ELSE 'one-shot' END AS file_kind,
  printf('Sound %04X', p_partkey) || coalesce(' ~' || heard, '') || ' (' || CASE ended_by WHEN 'loop' THEN 'loop' WHEN 'max' THEN printf('%.0f', round_even(seconds, 0)) || '+ s'
    ELSE CASE WHEN seconds < 10 THEN printf('%.1f s', round_even(seconds * 10, 0) / 10) ELSE printf('%.0f s', round_even(seconds, 0)) END END || ')' AS generated,
  concat_ws(', ', CASE WHEN ended_by = 'no_sound' THEN 'silent' END, CASE WHEN ended_by = 'max' THEN 'cut at max' END, CASE WHEN seconds < 10 THEN 'blip' END) AS flags
FROM k""")
def sound_rows(spark, sf_dir):
    """PRJ2, PRJ3, PRJ5, PRJ16, FN5: the kind, file kind, generated name and flags of each sound."""
    ended = F.col("ended_by")
    flags = R.flags([("silent", ended == "no_sound"), ("cut at max", ended == "max"), ("blip", F.col("seconds") < 10)])
    return sounds(spark, sf_dir).select(
        "p_partkey",
        R.kind(F.col("name"), F.col("playing"), F.col("heard")).alias("kind"),
        R.file_kind(F.col("playing"), F.col("p_partkey") % 3 == 0).alias("file_kind"),
        R.generated_name(X.id_text(F.col("p_partkey")), F.col("seconds"), ended, F.col("heard")).alias("generated"),
        F.array_join(flags, ", ").alias("flags"),
    )


_FAMILIES = ("DCS", "DCSP2K", "WPCS", "BSMT", "S11")


@query("""
WITH b AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'DCS' WHEN 1 THEN 'DCSP2K' WHEN 2 THEN 'WPCS' WHEN 3 THEN 'BSMT' ELSE 'S11' END AS family, p_partkey * 7 % 256 AS v, p_size % 3 AS lead, p_size % 4 > 0 AS checked FROM part),
r AS (SELECT p_partkey, family, v, CASE WHEN family = 'BSMT' THEN 254 WHEN family = 'WPCS' THEN 121 ELSE 170 + lead END AS b3, family = 'BSMT' AS two, CASE WHEN checked THEN 255 - v ELSE v END AS last FROM b),
f AS (SELECT p_partkey, CASE
  WHEN family = 'DCS' AND v + last = 255 AND b3 = 170 THEN {'kind': 'master', 'level': greatest(v - 7, 0) // 8, 'level_max': 31}
  WHEN family = 'DCS' AND v + last = 255 THEN {'kind': 'channel ' || printf('%02X', b3), 'level': v, 'level_max': 255}
  WHEN family = 'DCSP2K' AND v + last = 255 AND b3 = 170 THEN {'kind': 'master', 'level': CASE WHEN v = 255 THEN 31 ELSE v // 8 END, 'level_max': 31}
  WHEN family = 'DCSP2K' AND b3 = 171 AND v < 64 THEN {'kind': 'channel volume ' || printf('%02X', v), 'level': CASE WHEN last = 255 THEN 31 ELSE last // 8 END, 'level_max': 31}
  WHEN family = 'DCSP2K' AND b3 = 172 AND v < 64 THEN {'kind': 'channel pan ' || printf('%02X', v), 'level': last, 'level_max': 255}
  WHEN family = 'WPCS' AND v + last = 255 THEN {'kind': 'master', 'level': v, 'level_max': 31}
  WHEN two AND last BETWEEN 16 AND 47 THEN {'kind': 'master', 'level': 47 - last, 'level_max': 31} END AS c FROM r)
SELECT p_partkey, c.kind AS kind, CAST(c.level AS INTEGER) AS level, CAST(c.level_max AS INTEGER) AS level_max FROM f WHERE c IS NOT NULL""")
def volume_commands(spark, sf_dir):
    """PRJ9: the volume command at the end of a board's bytes."""
    family = F.element_at(F.array(*map(F.lit, _FAMILIES)), (F.col("p_partkey") % 5 + 1).cast("int"))
    v = F.col("p_partkey") * 7 % 256
    last = F.when(F.col("p_size") % 4 > 0, 255 - v).otherwise(v)
    third = F.when(family == "WPCS", 0x79).otherwise(0xAA + F.col("p_size") % 3)
    recent = F.when(family == "BSMT", F.array(F.lit(0xFE).cast("long"), last)).otherwise(F.array(F.lit(0x55).cast("long"), third.cast("long"), v, last))
    found = t(spark, sf_dir, "part").select("p_partkey", R.volume_command(family, recent).alias("c")).where("c is not null")
    return found.select("p_partkey", "c.kind", "c.level", "c.level_max")


@query("""
SELECT n_nationkey, 'N' || n_nationkey || '+R' || n_regionkey AS label, CASE WHEN n_nationkey % 3 < 2 THEN CASE n_nationkey % 3 WHEN 0 THEN 'rfm' ELSE 'swep1' END END AS game,
  CASE WHEN n_nationkey % 3 < 2 THEN CAST(100 + n_nationkey AS VARCHAR) END AS version FROM nation""")
def family_versions(spark, sf_dir):
    """PRJ7, PRJ20: labels of board families, and the game and version in a set's name."""
    key = F.col("n_nationkey")
    board = F.concat(F.lit("SNDBRD_N"), key.cast("string"), F.lit("+SNDBRD_R"), F.col("n_regionkey").cast("string"))
    name = F.concat(F.element_at(F.array(F.lit("rfm"), F.lit("swep1"), F.lit("other")), (key % 3 + 1).cast("int")), F.lit("_"), (key + 100).cast("string"), F.lit("r3"))
    found = t(spark, sf_dir, "nation").select("n_nationkey", R.family_label(board, F.lit(False)).alias("label"), R.game_version(name).alias("v"))
    return found.select("n_nationkey", "label", "v.game", "v.version")


@query("""
WITH f AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS fp FROM orders GROUP BY 1),
g AS (SELECT fp, count(*) AS n, list(o_custkey ORDER BY o_custkey)[1:7] AS first FROM f GROUP BY 1)
SELECT o_custkey, n - 1 AS n_others, array_to_string(list_filter(first, lambda x: x <> o_custkey)[1:6], ',') AS others FROM f JOIN g USING (fp)""")
def shared_sets(spark, sf_dir):
    """Who else has the same content, and the first six of them."""
    prints = t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("fp"))
    return C.shared(prints, "fp", "o_custkey").select("o_custkey", "n_others", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query("""
WITH l AS (SELECT o_custkey, l_partkey, l_suppkey, l_returnflag FROM lineitem JOIN (SELECT DISTINCT o_orderkey, o_custkey FROM orders) ON l_orderkey = o_orderkey),
m AS (SELECT DISTINCT o_custkey, l_partkey FROM l WHERE l_returnflag = 'R' EXCEPT SELECT o_custkey, l_partkey FROM l WHERE l_returnflag = 'A')
SELECT o_custkey, l_partkey, f.l_suppkey FROM m LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) f USING (l_partkey)""")
def missing_fill(spark, sf_dir):
    """What a set needs and lacks, from the first place that has it."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    owned = lines.join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").distinct(), "l_orderkey")
    return C.fill(owned.where("l_returnflag = 'R'"), owned.where("l_returnflag = 'A'"), lines.where("l_returnflag = 'N'"), ["o_custkey"], ["l_partkey"], "l_suppkey")


@query("""
SELECT w.p_partkey, coalesce(min(g.p_partkey) FILTER (g.p_name = w.p_name), min(g.p_partkey)) AS donor
FROM part w LEFT JOIN part g ON w.p_brand = g.p_brand AND w.p_type = g.p_type AND g.p_partkey % 10 > 0 WHERE w.p_partkey % 10 = 0 GROUP BY 1""")
def donor_files(spark, sf_dir):
    """A file that stands in for one that was never dumped, of its own name first."""
    part = t(spark, sf_dir, "part")
    return C.donors(part.where("p_partkey % 10 = 0"), part.where("p_partkey % 10 > 0"), ["p_brand", "p_type"], "p_partkey", "p_name")


@query("""
WITH used AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_returnflag = 'R'),
m AS (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag <> 'R')
SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN used.l_partkey IS NOT NULL THEN 'duplicate' WHEN p_size > 40 THEN 'rom-of-other-set' WHEN p_size % 3 = 0 THEN 'not-a-rom' ELSE 'unknown' END AS kind
FROM m LEFT JOIN used USING (l_orderkey, l_partkey) JOIN part ON p_partkey = m.l_partkey""")
def member_extras(spark, sf_dir):
    """SET8, PRJ12: members that no set used, and what they are."""
    lines = t(spark, sf_dir, "lineitem")
    used = lines.where("l_returnflag = 'R'").select("l_orderkey", "l_partkey").distinct().withColumn("used", F.lit(True))
    rest = lines.where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey", "l_suppkey").distinct()
    part = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name", "p_size")
    name = F.concat("p_name", F.when(F.col("p_size") % 3 == 0, ".TXT").otherwise(".u5"))
    kind = R.extra_kind(F.coalesce("used", F.lit(False)), F.col("p_size") > 40, name)
    return rest.join(used, ["l_orderkey", "l_partkey"], "left").join(part, "l_partkey").select("l_orderkey", "l_partkey", "l_suppkey", kind.alias("kind"))


@query("""
WITH b AS (SELECT o_custkey, o_orderkey, o_orderstatus = 'F' AS sounded FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal < 4000),
l AS (SELECT o_custkey, max(o_orderkey) AS last_sound FROM b WHERE sounded GROUP BY 1)
SELECT o_custkey, last_sound, min(o_orderkey) AS dead_from, count(*) AS silent_after FROM b JOIN l USING (o_custkey) WHERE o_orderkey > last_sound GROUP BY ALL""")
def dead_boards(spark, sf_dir):
    """Boards that fell silent for good."""
    samples = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    return C.dead_boards(t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), samples, "o_custkey", "o_orderkey", F.col("o_orderstatus") == "F", F.col("c_acctbal") >= 4000)


@query("""
WITH e AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) // 60000000 AS m FROM events)
SELECT a.event_id, count(*) AS inside FROM e a JOIN e b ON a.user_id = b.user_id AND b.m BETWEEN a.m AND a.m + CAST(floor(a.value * 20) AS BIGINT)
WHERE a.event_type = 'signup' AND b.event_type = 'click' GROUP BY 1""")
def interval_members(spark, sf_dir):
    """Events inside the span that each signup opens, a unit of value being twenty minutes."""
    found = events(spark, sf_dir).select("event_id", "user_id", "event_type", "value", F.expr("moment div 60000000").alias("m"))
    spans = found.where("event_type = 'signup'").select("event_id", "user_id", F.col("m").alias("begin"), (F.col("m") + F.floor(F.col("value") * 20).cast("long")).alias("end"))
    return C.within(found.where("event_type = 'click'").select("user_id", "m"), spans, ["user_id"], "m", "begin", "end").groupBy("event_id").agg(F.count("*").alias("inside"))


@query("""
WITH c AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (p_size < 35) AS h FROM lineitem LEFT JOIN part ON p_partkey = l_partkey GROUP BY 1)
SELECT CASE WHEN h = 0 THEN 'none' WHEN h = n THEN 'all' ELSE 'some' END AS have, count(*) AS calls FROM c GROUP BY 1""")
def call_coverage(spark, sf_dir):
    """AGG29, J20: calls of which all, some or none of the samples have a file."""
    files = t(spark, sf_dir, "part").where("p_size < 35").select(F.col("p_partkey").alias("l_partkey"))
    return C.call_coverage(t(spark, sf_dir, "lineitem"), files, "l_orderkey", "l_partkey")


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) < 3 OR count(DISTINCT l_linestatus) > 1")
def localized_samples(spark, sf_dir):
    """AGG30: samples that are not the same in all three languages."""
    return C.localized(t(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", "l_linestatus", 3)


@query("""
WITH l AS (SELECT user_id, event_id, CASE WHEN value < 60 THEN 0 ELSE CAST(floor(value) AS BIGINT) * CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END END AS level FROM events),
p AS (SELECT user_id, min(event_id) FILTER (level <> 0) AS start, arg_min(event_id, (-abs(level), event_id)) AS "full", arg_min(level, (-abs(level), event_id)) AS peak FROM l WHERE level <> 0 GROUP BY 1)
SELECT p.*, min(event_id) FILTER (level = 0) AS ends, min(event_id) FILTER (level <> peak) AS release FROM p JOIN l USING (user_id) WHERE event_id >= "full" GROUP BY ALL""")
def duck_phases(spark, sf_dir):
    """WIN22, TOP7: where a series of levels starts, is deepest, lets go and ends."""
    signed = F.when(F.col("value") < 60, 0).otherwise(F.floor("value") * F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1)).cast("long")
    return C.duck_phases(t(spark, sf_dir, "events").select("user_id", "event_id", signed.alias("level")), ["user_id"], "event_id", "level")


@query("""
WITH b AS (SELECT user_id, event_type, max(value) AS best FROM events GROUP BY ALL)
SELECT user_id, event_type, best, CAST(row_number() OVER (PARTITION BY user_id ORDER BY best DESC, event_type) AS INTEGER) AS rank FROM b QUALIFY rank <= 2""")
def class_tags(spark, sf_dir):
    """AGG23, TOP4: the largest share of each class over all windows, and the two best classes."""
    best = t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("best"))
    return top_with_remainder(best, ["user_id"], [F.desc("best"), F.asc("event_type")], ["event_type", "best"], 2).select("user_id", "event_type", "best", "rank")


@query("""
WITH w AS (SELECT r_name, n_name, count(c_custkey) AS weight FROM region JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT *, CAST(row_number() OVER (PARTITION BY r_name ORDER BY weight DESC, n_name) AS INTEGER) AS rank FROM w""")
def facet_weights(spark, sf_dir):
    """AGG35, AGG6: the makers of a facet by the sets they have, and then by name."""
    weights = t(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("weight"))
    named = t(spark, sf_dir, "nation").join(t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).join(weights, "n_nationkey", "left")
    rank = F.row_number().over(W.partitionBy("r_name").orderBy(F.desc("weight"), "n_name"))
    return named.select("r_name", "n_name", F.coalesce("weight", F.lit(0)).cast("long").alias("weight")).withColumn("rank", rank)


@query("""
WITH w AS (SELECT l_suppkey AS game, l_partkey AS code, min(l_shipdate)::VARCHAR AS name FROM lineitem GROUP BY ALL)
SELECT w.game, w.code, w.name FROM w LEFT JOIN w p ON p.game = w.game // 2 AND p.code = w.code
WHERE w.code % 5 > 0 AND (p.game IS NULL OR p.name <> w.name)""")
def needed_names(spark, sf_dir):
    """SET4: entries that neither upstream nor, under the same name, the parent lists; a game's parent has half its number."""
    wanted = t(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("game"), F.col("l_partkey").alias("code")).agg(F.min("l_shipdate").cast("string").alias("name"))
    upstream = wanted.where("code % 5 = 0")
    own = wanted.withColumn("parent", F.expr("game div 2"))
    return C.needed_names(own, upstream, wanted, ["game", "code"], ["parent", "code"], F.col("__name") != F.col("name")).select("game", "code", "name")


@query("""
WITH w AS (SELECT o_orderkey AS k, min(o_orderpriority) AS a FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'other' ELSE min(o_orderpriority) END AS b FROM orders WHERE o_orderkey % 11 > 0 GROUP BY 1)
SELECT CASE WHEN r.k IS NULL THEN 'missing' WHEN w.k IS NULL THEN 'foreign' WHEN a = b THEN 'same' ELSE 'misnamed' END AS state, count(*) AS n FROM w FULL JOIN r ON w.k = r.k GROUP BY 1""")
def read_back(spark, sf_dir):
    """SET6, AGG34: what a reader makes of what was written."""
    named = t(spark, sf_dir, "orders").groupBy("o_orderkey", "o_orderstatus").agg(F.min("o_orderpriority").alias("name"))
    wrote = named.where("o_orderstatus <> 'P'").groupBy("o_orderkey").agg(F.min("name").alias("name"))
    read = named.where("o_orderkey % 11 > 0").groupBy("o_orderkey").agg(F.min("name").alias("name"))
    return C.read_back(wrote, read.withColumn("name", F.when(F.col("o_orderkey") % 7 == 0, "other").otherwise(F.col("name"))), "o_orderkey", "name")


_GAIN = "least(greatest(floor(pow(10.0, ({0}) / 20) * 100 + 0.5), 0), 100)"


@query(f"""
WITH e AS (SELECT p_partkey AS id, p_size AS gain, -(p_retailprice % 30) AS lufs, p_partkey % 3 = 0 AS edited FROM part),
u AS (SELECT id, CASE WHEN edited THEN CAST({_GAIN.format("-12.0 + 1.5 - lufs")} AS INTEGER) ELSE gain END AS gain, lufs FROM e)
SELECT id, gain, {rounded_sql("CASE WHEN gain > 0 THEN lufs + 20 * log10(gain / 100.0) + 12.0 END", 2)} AS shift FROM u WHERE gain <> 100""")
def edit_merge(spark, sf_dir):
    """UPS4, UPS9: gains matched again to a new measurement, merged by id; neutral rows go."""
    base = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("gain"), (-(F.col("p_retailprice") % 30)).alias("lufs"))
    edits = base.where("id % 3 = 0").withColumn("gain", X.gain_percent(F.lit(-12.0) + 1.5 - F.col("lufs")))
    merged = C.upsert(base, edits, "id", F.col("gain") == 100)
    return merged.select("id", "gain", X.rounded(R.edit_offset(F.col("lufs"), F.col("gain"), F.lit(-12.0)), 2).alias("shift"))


@query("""
WITH r AS (SELECT l_suppkey, avg(CAST(round(l_quantity) AS BIGINT)) - 25 AS ref FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT l_suppkey, count(*) AS replayed, count(*) FILTER (CASE WHEN ref IS NOT NULL THEN abs(l_quantity - 25 - ref) > greatest(abs(ref) / 2, 3) ELSE abs(l_quantity - 25) < 3 END) AS ignores
FROM lineitem LEFT JOIN r USING (l_suppkey) WHERE l_returnflag = 'A' GROUP BY 1""")
def replay_follow(spark, sf_dir):
    """SEL4, STR7: replays that did not follow the reference of their board."""
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity")
    reference = lines.where("l_returnflag = 'R'").groupBy("l_suppkey").agg((F.avg(F.round("l_quantity").cast("long")) - 25).alias("ref"))
    replays = lines.where("l_returnflag = 'A'").join(reference, "l_suppkey", "left")
    return replays.groupBy("l_suppkey").agg(F.count("*").alias("replayed"), F.count_if(R.ignores_volume(F.col("l_quantity") - 25, F.col("ref"))).alias("ignores"))


@query("""
WITH c AS (SELECT o_custkey, o_orderkey, o_totalprice, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS tier FROM orders)
SELECT o_custkey, o_orderkey, tier, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY tier, o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM c WHERE tier IS NOT NULL QUALIFY rank <= 5""")
def offset_files(spark, sf_dir):
    """TOP5, SEL5: the loudest five eligible files, topped up from a second pool."""
    tier = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
    pool = t(spark, sf_dir, "orders").withColumn("tier", tier).where("tier is not null")
    return top_with_remainder(pool, ["o_custkey"], [F.asc("tier"), F.desc("o_totalprice"), F.asc("o_orderkey")], ["o_orderkey", "tier"], 5).select("o_custkey", "o_orderkey", "tier", "rank")


@query("""
SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS last_error, count(*) AS lines FROM conversations WHERE role = 'assistant' AND text IS NOT NULL GROUP BY 1""")
def last_errors(spark, sf_dir):
    """REP9: the last line of a kind in each log."""
    lines = t(spark, sf_dir, "conversations").where("role = 'assistant' and text is not null")
    counts = lines.groupBy("conv_id").agg(F.count("*").alias("lines"))
    return best_by(lines, ["conv_id"], [-F.col("turn")], ["turn", "text"]).withColumnRenamed("text", "last_error").join(counts, "conv_id")


@query("""
SELECT l_partkey, min(place) AS place, arg_min(v, place) AS v FROM (
  SELECT l_partkey, 1 AS place, min(l_suppkey) FILTER (l_returnflag = 'R') AS v FROM lineitem GROUP BY 1
  UNION ALL SELECT l_partkey, 2, max(l_suppkey) FILTER (l_returnflag = 'A') FROM lineitem GROUP BY 1) WHERE v IS NOT NULL GROUP BY 1""")
def resolved_paths(spark, sf_dir):
    """REP10, J24: an argument from the first place that has it."""
    lines = t(spark, sf_dir, "lineitem")
    one = lines.groupBy("l_partkey").agg(F.lit(1).alias("place"), F.min(F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))).alias("v"))
    two = lines.groupBy("l_partkey").agg(F.lit(2).alias("place"), F.max(F.when(F.col("l_returnflag") == "A", F.col("l_suppkey"))).alias("v"))
    return C.first_place(one.unionByName(two), ["l_partkey"], "place", "v")
