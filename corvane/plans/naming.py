"""Queries of names, reports, marks and selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import naming as N
from corvane.plans.registry import query, t


@query("""
WITH g AS (SELECT c_custkey // 2 AS id, min('N' || (c_custkey % 50 // 2)) AS a, max('N' || (c_custkey % 50 // 2 + CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END)) AS b FROM customer GROUP BY 1),
n AS (SELECT c_custkey // 2 AS id, 'N' || (c_custkey % 50 // 2 + CASE WHEN c_custkey % 10 = 1 THEN 1 ELSE 0 END) AS name FROM customer),
d AS (SELECT id, min(name) AS a, max(name) AS b FROM n GROUP BY 1)
SELECT id, CASE WHEN a <> b THEN 'conflict' WHEN p_partkey IS NULL THEN 'unknown' WHEN coalesce(old, '') <> a THEN 'changed' ELSE 'same' END AS state, old, CASE WHEN a = b THEN a END AS name
FROM d LEFT JOIN (SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN 'N' || (p_partkey % 25) END AS old FROM part WHERE p_partkey % 7 > 0) ON p_partkey = id""")
def applied_names(spark, sf_dir):
    """J13, UPS1: what each id of a names file does to the sounds."""
    key = F.col("c_custkey")
    number = F.expr("c_custkey % 50 div 2") + F.when(key % 10 == 1, 1).otherwise(0)
    text = F.when(key % 2 == 0, F.format_string("0x%04x", F.expr("c_custkey div 2"))).otherwise(F.format_string(" %X", F.expr("c_custkey div 2")))
    names = t(spark, sf_dir, "customer").select(text.alias("text"), key.alias("ord"), F.concat(F.lit("N"), number.cast("string")).alias("name"))
    part = F.col("p_partkey")
    sounds = t(spark, sf_dir, "part").where("p_partkey % 7 > 0").select(part.alias("id"), F.when(part % 3 > 0, F.concat(F.lit("N"), (part % 25).cast("string"))).alias("name"))
    return N.applied_names(sounds, names)


@query("""
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 4 > 0 AND lower(o_orderstatus) <> lower(CASE WHEN o_orderkey % 3 = 0 THEN 'f' ELSE 'O' END) THEN 'refused'
  WHEN (o_orderstatus = 'P' OR o_orderkey % 4 = 0) AND o_orderpriority[1] <> '3' THEN 'warned' ELSE 'ok' END AS verdict FROM orders""")
def name_guard(spark, sf_dir):
    """UPS2: names of other sounds are refused."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    own, pack = F.when(status != "P", status), F.when(key % 4 > 0, F.when(key % 3 == 0, "f").otherwise("O"))
    return t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", N.name_guard(own, pack, F.left("o_orderpriority", F.lit(1)), F.lit("3"), False).alias("verdict"))


@query("""
WITH f AS (SELECT s_suppkey AS file, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey END AS fp, s_suppkey % 25 AS rom FROM supplier),
g AS (SELECT n_nationkey AS game, n_nationkey // 2 AS measured, coalesce(CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey END, CASE WHEN n_nationkey % 5 > 0 THEN n_nationkey // 2 END) AS fp FROM nation)
SELECT DISTINCT game, file FROM f JOIN g ON (f.fp IS NOT NULL AND f.fp = g.fp) OR (f.fp IS NULL AND (rom = game OR rom = measured))""")
def names_for_games(spark, sf_dir):
    """The names files of each game, by content or else by name."""
    files = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey")).alias("fingerprint"), (F.col("s_suppkey") % 25).cast("int").alias("rom"))
    key = F.col("n_nationkey")
    half = F.expr("n_nationkey div 2").cast("int")
    games = t(spark, sf_dir, "nation").select(key.alias("game"), half.alias("measured"), F.when(key % 3 > 0, key).alias("fingerprint"), F.when(key % 5 > 0, half).alias("measured_fingerprint"))
    return N.names_for(files, games)


@query("""
WITH d AS (SELECT lower(p_name) AS n, arg_min(p_brand, p_partkey) AS fingerprint FROM part WHERE p_size > 10 GROUP BY 1)
SELECT p_partkey, upper(p_name) AS name, fingerprint FROM part LEFT JOIN d ON n = lower(p_name)""")
def named_fingerprints(spark, sf_dir):
    """REP6: the fingerprint of a set by its name, whatever the case."""
    part = t(spark, sf_dir, "part")
    drivers = part.where("p_size > 10").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"), F.col("p_brand").alias("fingerprint"))
    return N.fingerprint_of(part.select("p_partkey", F.upper("p_name").alias("name")), drivers)


@query("""
SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 2 = 0 THEN s_name || ': names neither a set nor its sounds, left out' END AS message FROM supplier""")
def names_files(spark, sf_dir):
    """REP7: files that say what they name, and why others are left out."""
    key = F.col("s_suppkey")
    files = t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("file"), F.when(key % 3 > 0, key).alias("fingerprint"), F.when(key % 2 > 0, key).alias("rom"))
    return N.accepted_files(files).select("s_suppkey", "message")


@query("""
SELECT doc_id, CASE WHEN coalesce(contains(text, 'viagra'), false) THEN 'not applicable' WHEN coalesce(n_chars, 0) < 40 THEN 'no sounds in the report' WHEN lang = 'fr' THEN 'no sound command' END AS reason,
  coalesce(contains(text, 'the'), false) AS article, coalesce(contains(text, ' 1'), false) AS number FROM documents""")
def report_exclusions(spark, sf_dir):
    """PRJ22, PRJ21: the first reason that keeps a report out, and the hints of its notes."""
    text = F.col("text")
    reason = N.first_reason([(F.contains(text, F.lit("viagra")), "not applicable"), (F.coalesce("n_chars", F.lit(0)) < 40, "no sounds in the report"), (F.col("lang") == "fr", "no sound command")])
    found = t(spark, sf_dir, "documents").select("doc_id", reason.alias("reason"), N.hints(text, [("article", "the"), ("number", " 1")]).alias("h"))
    return found.select("doc_id", "reason", "h.article", "h.number")


@query("""
WITH l(label, key) AS (VALUES ('Brand#11', 'a'), ('Brand#12', 'b'), ('Brand#13', 'c')), r(key, state, text) AS (VALUES ('a', 'never', 'no player'), ('b', 'newer', 'from version 2'))
SELECT p_partkey, p_brand AS label, CASE WHEN l.label IS NULL THEN 'yes' WHEN state = 'newer' THEN 'newer' ELSE 'no' END AS playable, CASE WHEN l.label IS NOT NULL THEN coalesce(text, '') END AS why
FROM part LEFT JOIN l ON l.label = p_brand LEFT JOIN r USING (key)""")
def playable_marks(spark, sf_dir):
    """SNK15, J25, SRC10: labels that do not play, or only in newer versions, and why."""
    labels = spark.createDataFrame([("Brand#11", "a"), ("Brand#12", "b"), ("Brand#13", "c")], "label string, key string")
    reasons = spark.createDataFrame([("a", "never", "no player"), ("b", "newer", "from version 2")], "key string, state string, text string")
    return N.marked_playable(t(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("label")), labels, reasons)


@query("""
SELECT key, CAST((min((part, ord)))[1] AS INTEGER) AS part, (min((part, ord)))[2] AS ord FROM (
  SELECT l_partkey AS key, 0 AS part, l_orderkey AS ord FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_partkey, 1, l_orderkey FROM lineitem WHERE l_returnflag = 'A' UNION ALL SELECT p_partkey, 2, p_partkey FROM part) GROUP BY 1""")
def command_union(spark, sf_dir):
    """SET2: the commands of several lists, each where it comes first."""
    lines = t(spark, sf_dir, "lineitem")
    pick = lambda flag: lines.where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("key"), F.col("l_orderkey").alias("ord"))
    return N.ordered_union([pick("R"), pick("A"), t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.col("p_partkey").alias("ord"))], "key")


@query("""
SELECT DISTINCT l_partkey FROM lineitem WHERE (l_returnflag = 'R' AND l_quantity > 45 OR l_returnflag = 'A' AND l_quantity < 3) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 30)""")
def touched_ids(spark, sf_dir):
    """SET7: sounds that an edit touches."""
    lines = t(spark, sf_dir, "lineitem")
    known = t(spark, sf_dir, "part").where("p_size < 30").select(F.col("p_partkey").alias("l_partkey"))
    return N.touched(lines.where("l_returnflag = 'R' and l_quantity > 45"), lines.where("l_returnflag = 'A' and l_quantity < 3"), known, "l_partkey")


@query("""
SELECT o_orderkey, ord, CASE WHEN k IS NULL THEN 0 ELSE 1 END AS place_group FROM (SELECT o_orderkey, min(o_totalprice) AS ord FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1)
LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity = 50) ON k = o_orderkey ORDER BY place_group, ord, o_orderkey LIMIT 100""")
def ordered_selection(spark, sf_dir):
    """TOP9: the first hundred commands that are asked for, those that end a session last."""
    only = t(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").groupBy("o_orderkey").agg(F.min("o_totalprice").alias("ord"))
    killers = t(spark, sf_dir, "lineitem").where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return N.selected(only, None, killers, "o_orderkey", 100)


@query("""
WITH r AS (SELECT user_id AS id, event_id AS ord, CASE WHEN event_type IN ('click', 'view') THEN 'base' ELSE 'extra' END AS kind, CASE WHEN event_id % 3 = 0 THEN 'off' ELSE 'on' END AS state, value FROM events),
e AS (SELECT id, coalesce(arg_max(state = 'off', ord) FILTER (kind = 'base'), false) AS base_off,
  string_agg('f' || (ord % 9) || ',' || CAST(least(greatest(floor(value + 0.5), 0), 100) AS INTEGER) || ',' || state, ' ' ORDER BY ord) FILTER (kind = 'extra') AS extras FROM r GROUP BY 1)
SELECT id, base_off, coalesce(extras, '') AS extras FROM e WHERE base_off OR extras IS NOT NULL""")
def line_edits(spark, sf_dir):
    """SRC14: the edits of each sound's line: its base off, and further lines."""
    basic = F.col("event_type").isin("click", "view")
    rows = t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("ord"), F.when(basic, "base").otherwise("extra").alias("kind"), F.when(F.col("event_id") % 3 == 0, "off").otherwise("on").alias("state"), F.concat(F.lit("f"), (F.col("event_id") % 9).cast("string")).alias("fname"), F.col("value").alias("gain"))
    return N.line_edits(rows).withColumn("extras", F.array_join("extras", " "))


@query("""
SELECT s_suppkey, '0x' || printf('%04X', s_suppkey) || ',' || CASE WHEN contains(n, ',') THEN '"' || n || '"' ELSE n END AS value FROM (SELECT s_suppkey, s_name || CASE WHEN s_suppkey % 3 = 0 THEN ', b' ELSE '' END AS n FROM supplier) WHERE s_suppkey % 5 > 0""")
def names_export(spark, sf_dir):
    """SNK8: the lines of a names file."""
    key = F.col("s_suppkey")
    name = F.when(key % 5 > 0, F.concat("s_name", F.when(key % 3 == 0, ", b").otherwise("")))
    rows = t(spark, sf_dir, "supplier").select("s_suppkey", name.alias("name")).where("name is not null and name != ''")
    return rows.select("s_suppkey", F.concat_ws(",", X.id_text(key), X.csv_field(F.col("name"))).alias("value"))
