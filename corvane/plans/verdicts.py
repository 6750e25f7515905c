"""Queries of verdicts: units, sets, entries and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import verdicts as V
from corvane.plans.registry import query, t


def scanned(spark, sf_dir):
    """Customers as units, their orders as the sets they match, and dear orders as members that no set needs."""
    orders = t(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    name = F.concat(F.lit("s"), key.cast("string"))
    status = F.when(F.col("o_orderstatus") == "F", "good").when(F.col("o_orderstatus") == "O", "split").when(key % 2 == 0, "bad-dump").otherwise("incomplete")
    sets = orders.where("o_totalprice < 150000").select(
        F.col("o_custkey").alias("unit"), key.alias("ord"), name.alias("set"), F.when(key % 2 == 0, F.concat(F.lit("s"), F.expr("o_orderkey div 4").cast("string"))).alias("parent"),
        F.col("o_orderpriority").startswith("5").alias("system"), status.alias("status"), F.when(key % 7 == 0, F.concat(F.lit("u"), key.cast("string"))).alias("unverified"),
        F.when(key % 6 == 0, F.array(F.lit(""), F.concat(F.lit("d"), (key % 10).cast("string")))).when(key % 9 == 0, F.array(F.lit("a"), F.lit("b"))).when(key % 4 == 0, F.array(F.lit(""))).alias("folders"),
        F.when(key % 5 == 0, F.concat(F.lit("r"), key.cast("string"))).alias("renamed"), F.concat(F.lit("f"), (key % 50).cast("string")).alias("fingerprint"))
    kind = F.element_at(F.array(*map(F.lit, ("not-a-rom", "unknown", "rom-of-other-set", "duplicate"))), (key % 4 + 1).cast("int"))
    extras = orders.where("o_totalprice >= 150000").select(F.col("o_custkey").alias("unit"), F.concat(F.lit("m"), key.cast("string")).alias("member"), kind.alias("kind"), F.when(key % 4 == 2, F.concat(F.lit("s"), F.expr("o_orderkey div 8").cast("string"))).alias("other"))
    first = sets.groupBy("unit").agg(F.min("ord").alias("least"))
    customer = F.col("unit")
    stem = F.when(customer % 3 == 0, F.concat(F.lit("S"), F.col("least").cast("string"))).when(customer % 3 == 1, F.concat(F.lit("s"), F.expr("least div 4").cast("string"))).otherwise("x")
    units = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("unit")).join(first, "unit", "left").select("unit", F.coalesce(stem, F.lit("x")).alias("stem"), (customer % 5 == 0).alias("support"))
    return units, sets, extras


_SCAN = """
WITH sets AS (
  SELECT o_custkey AS unit, o_orderkey AS ord, 's' || o_orderkey AS set, CASE WHEN o_orderkey % 2 = 0 THEN 's' || (o_orderkey // 4) END AS parent, o_orderpriority LIKE '5%' AS system,
    CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'split' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'bad-dump' ELSE 'incomplete' END END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN 'u' || o_orderkey END AS unverified, CASE WHEN o_orderkey % 5 = 0 THEN 'r' || o_orderkey END AS renamed,
    CASE WHEN o_orderkey % 6 = 0 THEN 'd' || (o_orderkey % 10) || '/' WHEN o_orderkey % 9 = 0 THEN 'a/, b/' END AS folders, 'f' || (o_orderkey % 50) AS fingerprint
  FROM orders WHERE o_totalprice < 150000),
units AS (
  SELECT c_custkey AS unit, coalesce(CASE c_custkey % 3 WHEN 0 THEN 'S' || least WHEN 1 THEN 's' || (least // 4) ELSE 'x' END, 'x') AS stem, c_custkey % 5 = 0 AS support
  FROM customer LEFT JOIN (SELECT unit, min(ord) AS least FROM sets GROUP BY 1) ON unit = c_custkey),
extras AS (
  SELECT o_custkey AS unit, 'm' || o_orderkey AS member, ['not-a-rom', 'unknown', 'rom-of-other-set', 'duplicate'][o_orderkey % 4 + 1] AS kind, CASE WHEN o_orderkey % 4 = 2 THEN 's' || (o_orderkey // 8) END AS other
  FROM orders WHERE o_totalprice >= 150000),
found AS (
  SELECT unit, any_value(stem) AS stem, count(*) AS n, bool_or(lower(set) = lower(stem)) AS named, bool_and(system AND status = 'good') AS all_system, bool_or(status IN ('good', 'split')) AS complete,
    bool_or(status = 'split') AS split, bool_and(status = 'bad-dump') AS bad, count(DISTINCT coalesce(parent, set)) AS families, min(coalesce(parent, set)) AS family, arg_min(set, ord) AS first,
    string_agg(set, ', ' ORDER BY ord, set) AS sets,
    string_agg(nullif(concat_ws(' | ', 'not verifiable: ' || unverified, 'subfolder: ' || set || ' is in ' || folders, 'files under another name: ' || renamed), ''), ' | ' ORDER BY ord, set) AS notes
  FROM sets JOIN units USING (unit) GROUP BY unit),
more AS (
  SELECT unit, string_agg(member, ', ' ORDER BY member) FILTER (kind = 'not-a-rom') AS no_content, string_agg(member, ', ' ORDER BY member) FILTER (kind = 'unknown') AS unknown,
    string_agg(member || ' (' || coalesce(other, kind) || ')', ', ' ORDER BY member) FILTER (kind IN ('rom-of-other-set', 'duplicate')) AS others
  FROM extras GROUP BY 1),
judged AS (
  SELECT u.unit, u.stem, u.support, f.* EXCLUDE (unit, stem), m.* EXCLUDE (unit), NOT named AND (n = 1 OR NOT (families = 1 AND family = u.stem)) AS misnamed, 'misnamed: named ' || u.stem || ', holds ' || first AS misname
  FROM units u LEFT JOIN found f ON f.unit = u.unit LEFT JOIN more m ON m.unit = u.unit),
verdicts AS (
  SELECT unit, CASE WHEN n IS NULL THEN CASE WHEN support THEN 'support' ELSE 'unknown' END WHEN all_system THEN 'support'
      WHEN complete THEN CASE WHEN split THEN 'split' WHEN misnamed THEN 'misnamed' ELSE 'ok' END WHEN bad THEN 'bad-dump' ELSE 'incomplete' END AS status,
    CASE WHEN n IS NULL THEN CASE WHEN support THEN 'support file, no set' ELSE 'no file of any set' END
      WHEN all_system THEN concat_ws(' | ', 'system files: ' || first, CASE WHEN NOT named THEN misname END)
      ELSE concat_ws(' | ', CASE WHEN n > 1 THEN 'merged: holds ' || n || ' sets (' || sets || ')' END, CASE WHEN misnamed THEN misname END, notes,
        'no content: ' || no_content, 'unknown files: ' || unknown, 'extra files: ' || others) END AS issues
  FROM judged)"""


@query(_SCAN + " SELECT * FROM verdicts")
def unit_verdicts(spark, sf_dir):
    """PRJ13: the status of each unit and its issues in order."""
    return V.unit_verdicts(*scanned(spark, sf_dir)).withColumn("issues", F.array_join("issues", " | "))


@query(_SCAN + " SELECT status, count(*) AS units FROM verdicts GROUP BY 1")
def scan_summary(spark, sf_dir):
    """AGG32: units by status."""
    return V.unit_verdicts(*scanned(spark, sf_dir)).groupBy("status").agg(F.count("*").alias("units"))


@query(_SCAN + """, s AS (SELECT fingerprint, set, min(ord) AS ord FROM sets WHERE status = 'good' AND NOT system GROUP BY ALL)
SELECT fingerprint, CAST(row_number() OVER (PARTITION BY fingerprint ORDER BY ord, set) AS INTEGER) AS place, set FROM s""")
def verified_groups(spark, sf_dir):
    """AGG32: the verified sets of each content, as they were first seen."""
    return V.verified_groups(scanned(spark, sf_dir)[1], "fingerprint")


@query(_SCAN + """, b AS (SELECT unit, arg_min({'set': set, 'status': s.status, 'named': lower(set) = lower(stem)}, (lower(set) <> lower(stem), ord, set)) AS s FROM sets s JOIN units USING (unit) GROUP BY 1)
SELECT unit, s.set AS set, v.status IN ('ok', 'split') AND s.status IN ('good', 'split') AND s.named AS extractable FROM b JOIN verdicts v USING (unit)""")
def best_sets(spark, sf_dir):
    """PRJ15: the set each unit is about, and whether work on it can start."""
    units, sets, extras = scanned(spark, sf_dir)
    return V.best_sets(units, sets, V.unit_verdicts(units, sets, extras))


@query("""
WITH s AS (SELECT p_type AS entry, p_partkey AS ord, p_partkey AS set, p_brand AS family, p_size % 3 AS sounds, p_size % 2 AS undumped, p_partkey % 4 > 0 AS audio FROM part),
w AS (SELECT *, CASE WHEN set % 50 = 0 THEN 'a test fixture' WHEN sounds = 0 AND audio THEN 'no sound is listed' WHEN sounds > 0 AND sounds = undumped THEN 'never dumped' END AS why FROM s),
e AS (SELECT entry || '/' || (set % 200) AS entry, ord, family, why FROM w)
SELECT entry, CASE WHEN arg_min(family, ord) = 'Brand#11' THEN 'no board to drive' WHEN bool_and(why IS NOT NULL) THEN arg_min(why, ord) END AS reason FROM e GROUP BY entry""")
def inapplicable_entries(spark, sf_dir):
    """PRJ6: entries for which there is nothing to do, and why."""
    key = F.col("p_partkey")
    part = t(spark, sf_dir, "part").select(F.concat("p_type", F.lit("/"), (key % 200).cast("string")).alias("entry"), key.alias("ord"), key.alias("set"), F.col("p_brand").alias("family"), (F.col("p_size") % 3).alias("sounds"), (F.col("p_size") % 2).alias("undumped"), (key % 4 > 0).alias("audio"))
    by_set = part.where("set % 50 = 0").select("set", F.lit("a test fixture").alias("reason"))
    by_family = spark.createDataFrame([("Brand#11", "no board to drive")], "family string, reason string")
    return V.not_applicable(part, by_set, by_family, "entry")


@query("""
SELECT s_suppkey AS set, s_nationkey AS code, coalesce(n_name, 'unknown') AS family, coalesce(CASE n_regionkey WHEN 0 THEN 'works' WHEN 1 THEN 'partial' END, 'untested') AS support,
  s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 49) AS found
FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 6 > 0) ON n_nationkey = s_nationkey""")
def catalogue_enrichment(spark, sf_dir):
    """The family of each set, how well it is supported, and whether it was found."""
    nation = t(spark, sf_dir, "nation").where("n_nationkey % 6 > 0")
    support = nation.select(F.col("n_name").alias("family"), F.when(F.col("n_regionkey") == 0, "works").when(F.col("n_regionkey") == 1, "partial").alias("support"))
    sets = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("set"), F.col("s_nationkey").alias("code"))
    found = t(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity > 49").select(F.col("l_suppkey").alias("set"))
    return V.enriched(sets, nation.select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("family")), support, found)


@query("""
WITH s AS (SELECT o_custkey, o_orderkey AS set, o_orderkey % 3 > 0 AS clone, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS figure, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderpriority END AS volume
  FROM (SELECT DISTINCT ON (o_orderkey) * FROM orders ORDER BY o_orderkey, o_custkey, o_totalprice)),
b AS (SELECT o_custkey, arg_min({'set': set, 'figure': figure, 'volume': volume}, (clone, set)) AS b FROM s WHERE figure IS NOT NULL GROUP BY 1)
SELECT o_custkey, b.set AS set, 'measured' AS role, b.figure AS figure, NULL AS caveat FROM b
UNION ALL SELECT s.o_custkey, s.set, 'differs', s.figure, CASE WHEN s.figure IS NULL THEN 'its volume differs from ' || b.b.set || '''s and it was not measured' END
FROM s JOIN b USING (o_custkey) WHERE s.set <> b.b.set AND s.volume IS NOT NULL AND s.volume IS DISTINCT FROM b.b.volume""")
def measured_sets(spark, sf_dir):
    """The measured set of each entry, and the sets whose volume differs from it."""
    rest = ["o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]
    orders = t(spark, sf_dir, "orders").groupBy("o_orderkey").agg(F.min(F.struct(*rest)).alias("o")).select("o_orderkey", "o.*")
    key = F.col("o_orderkey")
    sets = orders.select("o_custkey", key.alias("ord"), key.alias("set"), F.when(key % 3 > 0, key).alias("parent"))
    status, level = F.col("o_orderstatus"), F.col("o_orderpriority")
    runs = orders.select(key.alias("set"), F.when(status == "F", F.col("o_totalprice")).alias("figure"), F.when(status == "F", level).alias("volume"), F.when(status == "O", level).alias("boot_volume"))
    return V.measured_sets(sets, runs, "o_custkey")


@query("""
WITH r AS (SELECT event_id, value, event_id % 11 = 0 AS decoded, event_id % 3 > 0 AS complete, event_type AS volume_mode, CASE WHEN event_id % 5 = 0 THEN user_id END AS dead_from, event_id % 13 = 0 AS borrowed, event_id % 4 = 0 AS unscaled, event_id % 7 = 0 AS stepped FROM events)
SELECT event_id, CASE WHEN NOT decoded AND NOT unscaled AND NOT stepped THEN value END AS main, CASE WHEN decoded THEN value END AS static, CASE WHEN NOT decoded AND (unscaled OR stepped) THEN value END AS at_reference,
  nullif(concat_ws('; ', CASE WHEN decoded THEN 'decoded, not measured in a game' END, CASE WHEN NOT complete THEN 'a partial run' END,
    CASE WHEN NOT decoded THEN 'not at the factory volume (volume_mode ' || volume_mode || ')' END, 'incomplete: silent from ' || dead_from || ' on', CASE WHEN borrowed THEN 'approximate: another set''s sounds' END,
    CASE WHEN stepped THEN 'not at the game''s level: the step volume stands where it was at power-on' END, CASE WHEN NOT decoded AND unscaled AND NOT stepped THEN 'the factory offset could not be measured' END), '') AS caveat FROM r""")
def loudness_slots(spark, sf_dir):
    """PRJ18: where a level belongs, and what has to be said with it."""
    key = F.col("event_id")
    rows = t(spark, sf_dir, "events").select("event_id", "value", (key % 11 == 0).alias("decoded"), (key % 3 > 0).alias("complete"), F.col("event_type").alias("volume_mode"), F.when(key % 5 == 0, F.col("user_id")).alias("dead_from"), (key % 13 == 0).alias("borrowed"), (key % 4 == 0).alias("unscaled"), (key % 7 == 0).alias("stepped"))
    return V.loudness_slots(rows, "value").select("event_id", "main", "static", "at_reference", "caveat")


@query("""
SELECT o_custkey, coalesce(string_agg('board ' || (o_orderkey % 3) || ' (' || o_orderstatus || '): ' || o_orderpriority || ': ' || o_clerk, ' | ' ORDER BY o_orderkey), '') AS texts FROM (SELECT *, 'boot ' || (o_orderkey % 50) AS o_clerk FROM orders) GROUP BY 1""")
def recorded_volumes(spark, sf_dir):
    """PRJ24: at which volume boards were recorded, and where that is known from."""
    rows = t(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3).alias("board"), F.col("o_orderstatus").alias("family"), F.col("o_orderpriority").alias("volume"), F.concat(F.lit("boot "), (F.col("o_orderkey") % 50).cast("string")).alias("origin"))
    return V.recorded_volumes(rows, "o_custkey").select("o_custkey", F.array_join("texts", " | ").alias("texts"))


@query("""
WITH r AS (SELECT event_id, event_id % 3 AS version, event_id % 4 AS k, event_type <> 'error' AS known, CASE WHEN event_id % 6 = 0 THEN 'n' END AS reason, CAST(floor(value / 20) AS BIGINT) AS written FROM events)
SELECT event_id, known AND k = 1 AS current, known AND k = 1 AND version = 2 AND (reason IS NOT NULL OR written > 0) AS done FROM r""")
def current_runs(spark, sf_dir):
    """PRJ19, PRJ23: runs measured as they would be now, and those that need no repeat."""
    key = F.col("event_id")
    text = F.format_string('{"version": "1.%d", "method": 2, "k": "%d"}', key % 3, key % 4)
    rows = t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "error", text).alias("m"), F.when(key % 6 == 0, "n").alias("reason"), F.floor(F.col("value") / 20).alias("written"))
    now = '{"k": "1", "method": 2, "version": "1.2"}'
    return rows.select("event_id", V.is_current(F.col("m"), now).alias("current"), V.is_done(F.col("m"), now, False, F.col("reason"), F.col("written")).alias("done"))


@query("""
WITH j AS (SELECT user_id, CASE WHEN event_type = 'error' THEN 'failed' WHEN event_id % 6 = 0 THEN 'not_applicable' ELSE 'ok' END AS s, CAST(floor(value / 20) AS BIGINT) AS w FROM events)
SELECT user_id, count(*) FILTER (s = 'ok') AS ok, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'not_applicable') AS not_applicable,
  CAST(coalesce(sum(w) FILTER (s = 'ok'), 0) AS BIGINT) AS written, max(CAST(s = 'failed' AS INTEGER)) AS exit_code FROM j GROUP BY 1""")
def job_recap(spark, sf_dir):
    """AGG33: how the jobs of each user ended."""
    jobs = t(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") == "error", "e").alias("error"), F.when(F.col("event_id") % 6 == 0, "n").alias("reason"), F.floor(F.col("value") / 20).alias("written"))
    return V.recap(jobs, ["user_id"])
