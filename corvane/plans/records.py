"""Queries over the files that a pack keeps: names, line edits, saved base rows, manifests, and the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.plans.registry import query, t
from corvane.session import scratch
from corvane.sources import sinks, texts


@query("""
WITH p AS (SELECT s_suppkey AS pack, s_name AS rom, CASE WHEN s_suppkey % 3 > 0 THEN printf('%08x', s_suppkey) END AS id FROM supplier)
SELECT pack, 0 AS place, 0 AS ord, '# corvane names' AS value FROM p UNION ALL SELECT pack, 0, 1, '# rom: ' || rom FROM p UNION ALL SELECT pack, 0, 2, '# sound_rom_id: ' || id FROM p WHERE id IS NOT NULL
UNION ALL SELECT pack, 0, 3, '# corvane: 1.0' FROM p UNION ALL SELECT pack, 1, 4, 'ID,NAME' FROM p
UNION ALL SELECT DISTINCT l_suppkey, 2, l_partkey, printf('0x%04X', l_partkey) || ',' || CASE WHEN p_partkey % 2 = 0 THEN '"' || p_name || ', \"\"b\"\"\"' ELSE p_name END FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey % 5 > 0""")
def names_files_written(spark, sf_dir):
    """SNK8: the names file of each supplier's parts, with its comments; parts without a name have no line."""
    key = F.col("s_suppkey")
    packs = t(spark, sf_dir, "supplier").select(key.alias("pack"), F.col("s_name").alias("rom"), F.when(key % 3 > 0, F.format_string("%08x", key)).alias("sound_rom_id"), F.lit("1.0").alias("version"))
    part = F.col("p_partkey")
    name = F.when(part % 5 > 0, F.concat("p_name", F.when(part % 2 == 0, ', "b"').otherwise(""))).otherwise("")
    sold = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pack"), F.col("l_partkey").alias("ord")).distinct()
    sounds = sold.join(t(spark, sf_dir, "part").select(part.alias("ord"), F.format_string("  0x%x", part).alias("id"), name.alias("name")), "ord")
    return sinks.names_lines(packs, sounds, "corvane")


@query(r"""
WITH r AS (SELECT user_id AS id, event_id AS ord, event_type IN ('click', 'view') AS basic, CASE WHEN event_id % 3 = 0 THEN 'off' ELSE 'on' END AS state, value FROM events),
b AS (SELECT id, arg_max(state, ord) AS state FROM r WHERE basic GROUP BY 1)
SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS ord, 'ID,KIND,STATE,FNAME,GAIN,SOURCE' AS value UNION ALL SELECT id, -1, printf('0x%04X', id) || ',base,off,,,' FROM b WHERE state = 'off'
UNION ALL SELECT id, ord, printf('0x%04X', id) || ',extra,' || state || ',replace/f' || ord % 9 || '.wav,' || CAST(least(greatest(floor(value + 0.5), 0), 100) AS INTEGER) || ',t_' || ord % 7 || '.wav' FROM r WHERE NOT basic""")
def line_edit_record(spark, sf_dir):
    """SNK9: the record of line edits: bases that are off, and further lines with their sources."""
    id = F.col("event_id")
    kind = F.when(F.col("event_type").isin("click", "view"), "base").otherwise("extra")
    number = lambda n: (id % n).cast("string")
    rows = t(spark, sf_dir, "events").select(F.col("user_id").alias("id"), id.alias("ord"), kind.alias("kind"), F.when(id % 3 == 0, "off").otherwise("on").alias("state"), F.concat(F.lit("replace/f"), number(9), F.lit(".wav")).alias("fname"), F.col("value").alias("gain"), F.concat(F.lit("my\\.. t,"), number(7), F.lit(".wav")).alias("source"))
    return sinks.line_edit_lines(rows.withColumn("source", F.replace("source", F.lit(".. "), F.lit(""))))


@query("""SELECT 'f' || p_size % 2 || '.csv' AS file, p_partkey AS id, p_name || ',"' || p_size || '"' AS row FROM part""")
def base_rows_read_back(spark, sf_dir):
    """SRC15, SNK9: saved base rows written with their quotes, and read again."""
    row = F.concat("p_name", F.lit(',"'), F.col("p_size").cast("string"), F.lit('"'))
    bases = t(spark, sf_dir, "part").select(F.concat(F.lit("f"), (F.col("p_size") % 2).cast("string"), F.lit(".csv")).alias("file"), F.col("p_partkey").alias("id"), row.alias("row"))
    folder = scratch(spark, "bases")
    sinks.write_lines(sinks.base_lines(bases).withColumn("record", F.lit("lines-base")), folder, "record", ["file", "id"], "\r\n")
    return texts.saved_bases(texts.lines(spark, folder)).select("file", "id", "row")


@query("""
WITH s AS (SELECT n_nationkey AS k, coalesce(string_agg('{"set":' || s_suppkey || ',"name":"' || s_name || '"}', ',' ORDER BY s_suppkey), '') AS sets FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1)
SELECT 0 AS place, CAST(NULL AS BIGINT) AS n_nationkey, '{"format":1,"stats":{"sets":' || (SELECT count(*) FROM supplier) || ',"entries":' || (SELECT count(*) FROM nation) || '},"entries":[' AS value
UNION ALL SELECT 1, n_nationkey, '{"key":' || k || ',"label":"' || n_name || '","sets":[' || sets || ']}' || CASE WHEN k < (SELECT max(k) FROM s) THEN ',' ELSE '' END FROM s JOIN nation ON n_nationkey = k UNION ALL SELECT 2, NULL, ']}'""")
def catalogue_document(spark, sf_dir):
    """SNK5: the catalogue with its head and an entry a line."""
    nations, suppliers = t(spark, sf_dir, "nation"), t(spark, sf_dir, "supplier")
    sets = suppliers.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("set"), F.col("s_name").alias("name")))).alias("sets"))
    entries = nations.select(F.col("n_nationkey").cast("long"), F.col("n_nationkey").alias("key"), F.col("n_name").alias("label")).join(sets, "n_nationkey", "left")
    head = F.struct(F.lit(1).alias("format"), F.struct(F.lit(suppliers.count()).alias("sets"), F.lit(nations.count()).alias("entries")).alias("stats"))
    return sinks.catalogue_file(entries, "n_nationkey", ["key", "label", "sets"], head)


@query("""
WITH l AS (SELECT o_custkey AS pack, l_orderkey AS id, arg_max(l_partkey, (l_linenumber, 'f' || l_partkey || '.wav', l_returnflag, l_suppkey % 8, l_suppkey % 100)) AS p, arg_max(l_returnflag, (l_linenumber, 'f' || l_partkey || '.wav', l_returnflag, l_suppkey % 8, l_suppkey % 100)) AS f, arg_max(l_suppkey, (l_linenumber, 'f' || l_partkey || '.wav', l_returnflag, l_suppkey % 8, l_suppkey % 100)) AS s FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
e AS (SELECT o_custkey AS pack, o_orderkey AS id, '{"id":' || o_orderkey || ',"name":"' || o_orderpriority || '","seconds":' || o_orderkey % 90 ||
  CASE WHEN o_orderkey % 4 = 0 THEN ',"twin_of":' || o_orderkey - 1 || ',"twin":{"residual_db":-' || 60 + o_orderkey % 9 || '.25,"lag_samples":' || o_orderkey % 5 || '.5,"lufs_diff":0.125}' ELSE '' END ||
  CASE WHEN p IS NULL THEN '' ELSE ',"pack":{"file":"f' || p || '.wav","kind":"' || f || '","loop":' || CASE WHEN f = 'R' THEN 100 ELSE 0 END || ',"channel":' || s % 8 || ',"duck":' || s % 100 || ',"stop":' || CASE WHEN p % 2 = 0 THEN 1 ELSE 0 END || '}' END || '}' AS e
  FROM orders LEFT JOIN l ON l.pack = o_custkey AND l.id = o_orderkey),
g AS (SELECT pack, string_agg(e, ',' ORDER BY id) AS e FROM e GROUP BY 1)
SELECT c_custkey AS pack, '{"rom":"' || c_name || '"' || CASE WHEN c_custkey % 3 = 0 THEN ',"parent":"p' || c_custkey % 7 || '"' ELSE '' END || ',"mode":"' || CASE WHEN c_custkey % 2 = 0 THEN 'factory' ELSE 'normal' END || '","boards":[{"board":0,"family":"' || c_mktsegment || '"}' ||
  CASE WHEN c_custkey % 5 = 0 THEN ',{"board":1,"family":"second"}' ELSE '' END || ']' || ',"' || CASE WHEN c_custkey % 2 = 0 THEN 'factory_volume' ELSE 'game_volume' END || '":' || c_nationkey || ',"sounds":[' || coalesce(e, '') || ']}' AS value
FROM customer LEFT JOIN g ON g.pack = c_custkey""")
def manifest_lines(spark, sf_dir):
    """SNK4: each customer's orders as a nested manifest, with boards, twins and the last row of each sound."""
    customers, orders = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    key, id = F.col("c_custkey"), F.col("o_orderkey")
    packs = customers.select(key.alias("pack"), F.col("c_name").alias("rom"), F.when(key % 3 == 0, F.concat(F.lit("p"), (key % 7).cast("string"))).alias("parent"), (key % 2 == 0).alias("factory"), F.col("c_nationkey").alias("volume"))
    both = F.array(F.struct(F.lit(0).alias("board"), F.col("c_mktsegment").alias("family")), F.when(key % 5 == 0, F.struct(F.lit(1).alias("board"), F.lit("second").alias("family"))))
    boards = customers.select(key.alias("pack"), F.explode(F.array_compact(both)).alias("b")).select("pack", "b.board", "b.family")
    sounds = orders.select(F.col("o_custkey").alias("pack"), id.alias("ord"), id.alias("id"), F.col("o_orderpriority").alias("name"), (id % 90).alias("seconds"))
    lines = t(spark, sf_dir, "lineitem").join(orders.select(id.alias("l_orderkey"), F.col("o_custkey").alias("pack")), "l_orderkey")
    part, supplier = F.col("l_partkey"), F.col("l_suppkey")
    rows = lines.select("pack", F.col("l_linenumber").alias("ord"), F.col("l_orderkey").alias("id"), F.concat(F.lit("f"), part.cast("string"), F.lit(".wav")).alias("file"), F.col("l_returnflag").alias("kind"), (F.col("l_returnflag") == "R").alias("loop"), (supplier % 8).alias("channel"), (supplier % 100).alias("duck"), (part % 2 == 0).alias("stop"))
    twins = orders.where(id % 4 == 0).select(F.col("o_custkey").alias("pack"), id.alias("id"), (id - 1).alias("of"), (-(60 + id % 9) - 0.2501).alias("residual_db"), (id % 5 + 0.4999).alias("lag"), F.lit(0.1252).alias("lufs_diff"))
    return sinks.manifests(packs, boards, sounds, rows, twins)
