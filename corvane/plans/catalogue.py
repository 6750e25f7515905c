"""Queries over groups: fingerprints, tallies, levels. An order plays a set, its parts the content files."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import grouping as G
from corvane.plans.registry import query, t

DIGITS = "CAST(sign({0}) * floor(abs({0}) * {1} + 0.5) AS DOUBLE) / {1}"


def rounded_sql(x: str, digits: int) -> str:
    return DIGITS.format(x, f"{10**digits}.0")


@query("""
SELECT l_orderkey, CASE WHEN bool_and(l_partkey IS NOT NULL) THEN sha1(string_agg(d, chr(10) ORDER BY d) || chr(10)) END AS fingerprint, count(d) AS n_files
FROM (SELECT DISTINCT l_orderkey, l_partkey, sha1(CAST(l_partkey AS VARCHAR)) AS d FROM lineitem) GROUP BY l_orderkey""")
def content_fingerprint(spark, sf_dir):
    """AGG1: SHA-1 over the sorted distinct digests of an order's parts."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.sha1(F.col("l_partkey").cast("string").cast("binary")).alias("d"))
    return G.fingerprint(lines, ["l_orderkey"], "d")


@query("""
WITH f AS (
  SELECT o_custkey, sha1(string_agg(d, chr(10) ORDER BY d) || chr(10)) AS fp
  FROM (SELECT DISTINCT o_custkey, sha1(o_orderpriority) AS d FROM orders) GROUP BY o_custkey),
m AS (SELECT c_custkey, c_name, c_acctbal, coalesce(fp, 'set:' || CAST(c_custkey AS VARCHAR)) AS key FROM customer LEFT JOIN f ON o_custkey = c_custkey)
SELECT key, count(*) AS members, arg_min(c_name, (c_acctbal < 0, c_custkey)) AS head, min(c_custkey) AS first_key FROM m GROUP BY key""")
def fingerprint_groups(spark, sf_dir):
    """AGG2, AGG4, TOP1: customers grouped by the set of their order priorities; a customer without orders alone."""
    orders = t(spark, sf_dir, "orders").select("o_custkey", F.sha1(F.col("o_orderpriority").cast("binary")).alias("d"))
    prints = G.fingerprint(orders, ["o_custkey"], "d").select(F.col("o_custkey").alias("c_custkey"), "fingerprint")
    members = t(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").join(prints, "c_custkey", "left")
    members = members.withColumn("key", G.group_key(F.col("fingerprint"), F.col("c_custkey")))
    head = F.min(F.struct((F.col("c_acctbal") < 0).alias("later"), "c_custkey", "c_name"))
    return members.groupBy("key").agg(F.count("*").alias("members"), head.getField("c_name").alias("head"), F.min("c_custkey").alias("first_key")).orderBy("first_key", "key")


@query("""
SELECT l_suppkey, l_returnflag, n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY n DESC, l_returnflag) AS r
  FROM (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY ALL)) WHERE r = 1""")
def dominant_family(spark, sf_dir):
    """AGG3: the most frequent return flag of each supplier."""
    return G.dominant(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_returnflag")


@query("""
SELECT o_custkey, CASE WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE CAST(lo AS VARCHAR) || '-' || CAST(hi AS VARCHAR) END AS years
FROM (SELECT o_custkey, min(year(o_orderdate)) AS lo, max(year(o_orderdate)) AS hi FROM orders GROUP BY o_custkey)""")
def year_span(spark, sf_dir):
    """AGG5: the years of each customer's orders."""
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(G.year_span(F.year("o_orderdate"), F.lit(True)).alias("years"))


@query("""
SELECT o_custkey, min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END) AS best FROM orders GROUP BY o_custkey""")
def best_state(spark, sf_dir):
    """AGG7: the best of ordered states."""
    order = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).when(F.col("o_orderstatus") == "P", 2)
    return t(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(order).alias("best"))


@query("""
SELECT o_orderstatus, o_orderpriority, count(*) AS sets, count(*) FILTER (o_totalprice > 200000) AS dear, count(*) FILTER (o_totalprice <= 200000) AS cheap
FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def tally_stats(spark, sf_dir):
    """AGG8: tallies overall, by state and by priority in one pass."""
    t(spark, sf_dir, "orders").createOrReplaceTempView("__orders")
    return spark.sql("""
      SELECT o_orderstatus, o_orderpriority, count(*) AS sets, count_if(o_totalprice > 200000) AS dear, count_if(o_totalprice <= 200000) AS cheap
      FROM __orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")


@query("""SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS level, max(event_id) AS last_id FROM events GROUP BY ALL""")
def last_event_per_kind(spark, sf_dir):
    """AGG9: the last event of each kind; ties in time go to the larger id."""
    last = F.max(F.struct("ts", "event_id", "value"))
    return t(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(last.getField("value").alias("level"), F.max("event_id").alias("last_id"))


COUNTERS = {
    "lines": "true", "returned": "l_returnflag = 'R'", "accepted": "l_returnflag = 'A'", "open": "l_linestatus = 'O'", "full_price": "l_discount = 0",
    "deep_discount": "l_discount >= 0.09", "untaxed": "l_tax = 0", "single": "l_quantity = 1", "bulk": "l_quantity >= 45", "dear": "l_extendedprice > 50000",
}


@query("SELECT " + ", ".join(f"count(*) FILTER ({c}) AS {n}" for n, c in COUNTERS.items()) + " FROM lineitem")
def counters_one_pass(spark, sf_dir):
    """AGG10: ten conditional counts in one pass."""
    return t(spark, sf_dir, "lineitem").agg(*[F.count_if(F.expr(c)).alias(n) for n, c in COUNTERS.items()])


REASONS = [("returned", "l_returnflag = 'R'"), ("open", "l_linestatus = 'O'"), ("discounted", "l_discount >= 0.05"), ("small", "l_quantity < 10")]


@query("SELECT CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in REASONS) + " ELSE 'written' END AS reason, count(*) AS n FROM lineitem GROUP BY 1")
def coverage_histogram(spark, sf_dir):
    """AGG11, PRJ11: every line has one reason, the first that holds."""
    lines = t(spark, sf_dir, "lineitem")
    return lines.groupBy(G.reasons(lines, [(n, F.expr(c)) for n, c in REASONS], "written").alias("reason")).agg(F.count("*").alias("n"))


@query("""
SELECT l_partkey // 50 AS part_range, count(*) AS swept, count(*) FILTER (l_returnflag = 'A') AS sounding, max(l_partkey) FILTER (l_returnflag = 'A') AS last_sounding
FROM lineitem GROUP BY 1""")
def range_results(spark, sf_dir):
    """AGG12: what each range of ids gave, and the last id that did."""
    sounding = F.col("l_returnflag") == "A"
    return t(spark, sf_dir, "lineitem").groupBy(F.expr("l_partkey div 50").alias("part_range")).agg(
        F.count("*").alias("swept"), F.count_if(sounding).alias("sounding"), F.max(F.when(sounding, F.col("l_partkey"))).alias("last_sounding"))


@query("""
WITH heard AS (SELECT user_id, CAST(round(value * 100) AS BIGINT) AS e FROM events WHERE round(value * 100) >= pow(10, -6.9309)),
a AS (SELECT user_id, avg(e) AS m FROM heard GROUP BY 1),
b AS (SELECT user_id, count(*) AS n_blocks, avg(e) AS mean_energy FROM heard JOIN a USING (user_id) WHERE e >= greatest(pow(10, -6.9309), m * pow(10, -1)) GROUP BY 1)
SELECT user_id, coalesce(n_blocks, 0) AS n_blocks, mean_energy, CASE WHEN mean_energy > 0 THEN -0.691 + 10 * log10(mean_energy) END AS lufs
FROM (SELECT DISTINCT user_id FROM events) LEFT JOIN b USING (user_id)""")
def gated_mean(spark, sf_dir):
    """AGG13, AGG14, FN9: two-stage gated loudness of each user's energies, which are whole hundredths."""
    energies = t(spark, sf_dir, "events").select("user_id", F.round(F.col("value") * 100).cast("long").alias("energy"))
    return G.gated(energies, ["user_id"], "energy")


@query(f"""SELECT event_type, count(value) AS n, {rounded_sql("m", 3)} AS median FROM (SELECT event_type, value, median(value) OVER (PARTITION BY event_type) AS m FROM events) WHERE value IS NOT NULL GROUP BY event_type, m""")
def median_level(spark, sf_dir):
    """AGG15: the middle value, or the mean of the two middle ones."""
    return G.median(t(spark, sf_dir, "events"), ["event_type"], "value")


@query("""
WITH m AS (SELECT event_type, count(value) AS n, list_sort(list(value) FILTER (value IS NOT NULL))[CAST(count(value) // 2 AS BIGINT) + 1] AS middle FROM events GROUP BY 1)
SELECT event_type, n, middle, away[CAST(n // 2 AS BIGINT) + 1] * 1.4826 AS mad FROM (
  SELECT event_type, n, middle, list_sort(list(abs(value - middle)) FILTER (value IS NOT NULL)) AS away FROM events JOIN m USING (event_type) GROUP BY event_type, n, middle)""")
def upper_median_mad(spark, sf_dir):
    """AGG16, AGG17: the upper median and the scaled median distance from it."""
    return G.spread_around_upper_median(t(spark, sf_dir, "events"), ["event_type"], "value")


@query("""SELECT l_suppkey, count(*) AS n, list_sort(list(l_extendedprice))[CAST((count(*) - 1) * 99 // 100 AS BIGINT) + 1] AS p99 FROM lineitem WHERE l_extendedprice IS NOT NULL GROUP BY 1""")
def p99_index(spark, sf_dir):
    """AGG18: the value at index (n - 1) * 99 / 100."""
    return G.order_statistics(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice", {"p99": G.P99_INDEX})


@query(f"""
WITH m AS (SELECT event_type, {rounded_sql("median(value)", 3)} AS m FROM events GROUP BY 1),
w AS (SELECT event_type, value, abs(value - m) <= 30 AS near FROM events JOIN m USING (event_type) WHERE value IS NOT NULL)
SELECT event_type, {rounded_sql("(median(value) FILTER (near))", 3)} AS gain, count(*) FILTER (near) AS n_inliers, count(*) FILTER (NOT near) AS n_outliers,
  max(value) FILTER (near) - min(value) FILTER (near) AS spread FROM w GROUP BY 1""")
def inlier_gain(spark, sf_dir):
    """AGG19, AGG20: the median of the values near the median of all."""
    return G.inlier_gain(t(spark, sf_dir, "events").where("value is not null"), ["event_type"], "value", 30.0)


@query(f"""
SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 0.0
  WHEN count(*) FILTER (event_type = 'purchase' AND value > 20) > 0 THEN {rounded_sql("(median(value) FILTER (event_type = 'purchase' AND value > 20))", 3)}
  WHEN bool_and(value = 0) FILTER (event_type = 'purchase') THEN 0.0 END AS "offset" FROM events GROUP BY 1""")
def offset_rules(spark, sf_dir):
    """AGG21: zero without a master; else the median of the samples; else zero only if all are."""
    events = t(spark, sf_dir, "events")
    master = F.col("event_type") == "purchase"
    middle = G.median(events.where(master & (F.col("value") > 20)), ["user_id"], "value").select("user_id", "median")
    seen = events.groupBy("user_id").agg(F.count_if(master).alias("masters"), F.bool_and(F.when(master, F.col("value") == 0)).alias("zero"))
    out = F.when(F.col("masters") == 0, 0.0).when(F.col("median").isNotNull(), F.col("median")).when(F.col("zero"), 0.0)
    return seen.join(middle, "user_id", "left").select("user_id", out.alias("offset"))


@query("""
SELECT l_returnflag, rank, l_orderkey, l_extendedprice, CAST(greatest(n - 20, 0) AS BIGINT) AS more FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_partkey, l_suppkey, l_linenumber) AS INTEGER) AS rank,
    count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE rank <= 20""")
def top_with_remainder(spark, sf_dir):
    """AGG22, TOP3: the twenty dearest lines of each flag, and how many more there are."""
    order = [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_linenumber")]
    return G.top_with_remainder(t(spark, sf_dir, "lineitem"), ["l_returnflag"], order, ["l_orderkey", "l_extendedprice"], 20)


@query("""SELECT l_orderkey, bit_or(CAST(1 AS BIGINT) << l_linenumber) AS mask FROM lineitem GROUP BY 1""")
def channel_mask(spark, sf_dir):
    """AGG24: the line numbers of an order as bits."""
    return G.channel_mask(t(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_linenumber")


@query("""
SELECT l_suppkey, l_linenumber, voices, n FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY voices DESC, l_linenumber) AS r FROM (
    SELECT l_suppkey, l_linenumber, count(*) FILTER (l_returnflag = 'N') AS voices, count(*) AS n FROM lineitem GROUP BY ALL) WHERE voices * 2 > n) WHERE r = 1""")
def elect_channel(spark, sf_dir):
    """AGG25: the line number that is mostly of one flag and has most of it."""
    return G.elect(t(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_linenumber", F.col("l_returnflag") == "N")


@query("""
SELECT l_discount, l_extendedprice, l_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY l_discount ORDER BY l_extendedprice DESC, l_orderkey) AS r FROM lineitem) WHERE r = 1""")
def best_per_depth(spark, sf_dir):
    """AGG26: the dearest line of each discount."""
    order = [-F.col("l_extendedprice"), F.col("l_orderkey")]
    return G.best_by(t(spark, sf_dir, "lineitem"), ["l_discount"], order, ["l_extendedprice", "l_orderkey"])


@query(f"""
SELECT event_id, {rounded_sql("value", 1)} AS r1, {rounded_sql("value / 7", 3)} AS r3, CAST(printf('0x%04X', event_id) AS VARCHAR) AS id_text,
  CAST(least(greatest(floor(pow(10, -value / 20 / 20) * 100 + 0.5), 0), 100) AS INTEGER) AS gain,
  -0.691 + 10 * log10(value) AS lufs, greatest(1, CAST(ceil((value - 10) / 25) AS INTEGER)) AS cycles FROM events WHERE value > 0""")
def level_functions(spark, sf_dir):
    """FN1, FN9, FN10, FN19: ids, rounding, gains and levels."""
    v = F.col("value")
    return t(spark, sf_dir, "events").where("value > 0").select(
        "event_id", X.rounded(v, 1).alias("r1"), X.rounded(v / 7, 3).alias("r3"), X.id_text(F.col("event_id")).alias("id_text"),
        X.gain_percent(-v / 20).alias("gain"), X.energy_to_lufs(v).alias("lufs"), X.extended_cycles(v, F.lit(10.0), F.lit(25.0)).alias("cycles"))
