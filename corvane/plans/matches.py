"""Queries over joins, set operations and edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import exprs as X
from corvane.operators import grouping as G
from corvane.operators import matching as M
from corvane.plans.registry import query, t


def identification(spark, sf_dir, by_unit: bool = False):
    """Orders as units and parts as sets of files: a member is a line, its crc the part and its size the line number. Dealt by
    unit, members are made distinct and listed by unit after one shuffle, in tasks that do not grow with the table."""
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("unit"), F.col("l_partkey").alias("crc"), F.col("l_linenumber").alias("size"))
    lines = (M.dealt(lines, lines.count(), ["unit"]) if by_unit else lines).distinct()
    members = lines.select("unit", (F.col("crc") * 10 + F.col("size")).alias("ord"), F.concat(F.lit("P"), F.col("crc") % 400).alias("name"), "crc", "size")
    parts = t(spark, sf_dir, "part").select("p_partkey", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    files = parts.select(
        F.expr("p_partkey div 5").alias("set"), (F.col("p_partkey") * 10 + F.col("i")).alias("ord"), F.concat(F.lit("p"), F.col("p_partkey") % 400).alias("name"),
        F.when(F.col("p_partkey") % 7 == 0, F.lit(-1).cast("long")).otherwise(F.col("p_partkey")).alias("crc"), F.col("i").alias("size"), (F.col("p_partkey") % 11 == 0).alias("no_dump"))
    return members, files


_ID = """
WITH members AS (SELECT DISTINCT l_orderkey AS unit, l_partkey * 10 + l_linenumber AS ord, 'P' || (l_partkey % 400) AS name, l_partkey AS crc, l_linenumber AS size FROM lineitem),
files AS (SELECT p_partkey // 5 AS set, p_partkey * 10 + i AS ord, 'p' || (p_partkey % 400) AS name, CASE WHEN p_partkey % 7 = 0 THEN -1 ELSE p_partkey END AS crc, i AS size, p_partkey % 11 = 0 AS no_dump
  FROM part, (SELECT unnest([1, 2, 3]) AS i)),
pairs AS (SELECT unit, set FROM members m JOIN files f ON m.crc = f.crc AND m.size = f.size WHERE NOT no_dump UNION SELECT unit, set FROM members m JOIN files f ON lower(m.name) = lower(f.name) WHERE no_dump)"""


@query(_ID + " SELECT * FROM pairs")
def candidate_match(spark, sf_dir):
    """Sets that share a file with a unit by content, or by name where it was never dumped."""
    return M.candidates(*identification(spark, sf_dir, by_unit=True))


_MATCHED = _ID + """,
want AS (SELECT unit, f.* FROM pairs JOIN files f USING (set)),
tiers AS (
  SELECT w.unit, w.set, w.ord, m.ord AS m, CASE WHEN lower(w.name) = lower(m.name) THEN 0 ELSE 1 END AS tier FROM want w JOIN members m ON w.unit = m.unit AND w.crc = m.crc AND w.size = m.size WHERE NOT no_dump
  UNION ALL SELECT w.unit, w.set, w.ord, m.ord, CASE WHEN no_dump THEN 0 ELSE 2 END FROM want w JOIN members m ON w.unit = m.unit AND lower(w.name) = lower(m.name)),
best AS (SELECT unit, set, ord, min((tier, m)) AS b FROM tiers GROUP BY ALL),
matched AS (SELECT unit, set, ord, CASE b[1] WHEN 0 THEN 'good' WHEN 1 THEN 'renamed' WHEN 2 THEN 'wrong' ELSE 'missing' END AS status, b[2] AS member FROM want LEFT JOIN best USING (unit, set, ord))"""


@query(_MATCHED + " SELECT * FROM matched")
def file_match(spark, sf_dir):
    """Which member each file of a candidate set is."""
    return M.match_candidates(*identification(spark, sf_dir, by_unit=True))


@query(_MATCHED + """, c AS (SELECT unit, set, count(*) FILTER (status IN ('good', 'renamed')) AS found, count(*) FILTER (status IN ('wrong', 'missing')) AS bad FROM matched GROUP BY ALL)
SELECT unit, set, found, bad FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY found DESC, bad, set) AS r FROM c) WHERE r = 1""")
def closest_set(spark, sf_dir):
    """TOP2: the set that a unit comes closest to."""
    return M.closest_sets(*identification(spark, sf_dir))


@query("""
WITH chain AS (SELECT c_custkey, s_suppkey AS unit, CASE WHEN s_nationkey = c_nationkey THEN 0 ELSE 1 END AS tier, s_suppkey FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN (SELECT s_suppkey, s_nationkey, n_regionkey AS r FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON r = n_regionkey),
holds AS (SELECT DISTINCT l_suppkey AS unit, l_linenumber AS need FROM lineitem),
needs AS (SELECT c_custkey, unnest([1, 3, 5, 7]) AS need FROM customer)
SELECT n.c_custkey, n.need, arg_min(h.unit, (tier, h.unit)) AS supplier FROM needs n LEFT JOIN (chain JOIN holds h USING (unit)) AS h ON h.c_custkey = n.c_custkey AND h.need = n.need GROUP BY ALL""")
def ordered_cover(spark, sf_dir):
    """Each need from the first of an ordered chain that holds it: suppliers of the nation, then of the region."""
    nation = t(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    suppliers = t(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_regionkey")
    customers = t(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "n_regionkey")
    holds = t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("unit"), F.col("l_linenumber").alias("need")).distinct()
    # A chain is a place and not a customer: needs of a nation are looked up once.
    places = nation.join(suppliers, "n_regionkey").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("s_suppkey").alias("unit"), F.struct((F.col("s_nationkey") != F.col("n_nationkey")).cast("int").alias("tier"), "s_suppkey").alias("ord"))
    needs = nation.select(F.col("n_nationkey").alias("c_nationkey"), F.explode(F.array(*map(F.lit, (1, 3, 5, 7)))).alias("need"))
    found = M.supplier_of(needs, places, holds, ["c_nationkey"], "need")
    return customers.join(found, "c_nationkey").select("c_custkey", "need", "supplier")


@query("""
SELECT c_custkey, coalesce(s.v, n.v, 'default') AS note, CASE WHEN s.v IS NOT NULL THEN 'segment' WHEN n.v IS NOT NULL THEN 'nation' END AS tier FROM customer
LEFT JOIN (VALUES ('BUILDING', 'b'), ('MACHINERY', 'm')) s(c_mktsegment, v) USING (c_mktsegment) LEFT JOIN (SELECT n_nationkey, n_name AS v FROM nation WHERE n_regionkey < 2) n ON n_nationkey = c_nationkey""")
def tiered_lookup(spark, sf_dir):
    """The first table that has a value."""
    segments = spark.createDataFrame([("BUILDING", "b"), ("MACHINERY", "m")], "c_mktsegment string, note string")
    nations = t(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("note"))
    customers = t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    found = M.first_tier(customers, [("segment", segments, ["c_mktsegment"]), ("nation", nations, ["c_nationkey"])], "note")
    return found.select("c_custkey", F.coalesce("note", F.lit("default")).alias("note"), "tier")


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders),
f AS (SELECT o_custkey, arg_min(price, o_orderkey) AS p FROM o WHERE price IS NOT NULL GROUP BY 1)
SELECT o_orderkey, coalesce(price, p) AS price, price IS NULL AND p IS NOT NULL AS inherited FROM o LEFT JOIN f USING (o_custkey)""")
def inherit_parent(spark, sf_dir):
    """A missing figure from the first relative that has it."""
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders = t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", price.alias("price"))
    return M.inherit(orders, ["o_custkey"], "price", F.col("o_orderkey")).select("o_orderkey", "price", "inherited")


@query("""
WITH k AS (SELECT CAST(c_custkey AS VARCHAR) AS k FROM customer)
SELECT n.k AS name, h.k AS heading FROM k n JOIN k h ON starts_with(n.k, h.k) AND n.k <> h.k""")
def prefix_readers(spark, sf_dir):
    """Names that begin with a heading."""
    keys = t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    return M.prefixes_of(keys, keys.select(F.col("name").alias("heading")))


@query("""
SELECT l_suppkey, l_discount FROM (SELECT DISTINCT l_suppkey, l_discount, l_returnflag FROM lineitem) GROUP BY ALL
HAVING count(*) = (SELECT count(DISTINCT l_returnflag) FROM lineitem)""")
def universal_match(spark, sf_dir):
    """Suppliers and discounts whose lines show every flag."""
    lines = t(spark, sf_dir, "lineitem")
    return M.universal(lines.select("l_returnflag"), lines, ["l_suppkey", "l_discount"], "l_returnflag")


@query("""
WITH l AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS ord FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem)),
p AS (SELECT a.l_partkey, a.l_suppkey, a.ord AS x, b.ord AS y FROM l a JOIN l b ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.ord < b.ord AND abs(a.l_quantity - b.l_quantity) <= 1 AND abs(a.l_extendedprice - b.l_extendedprice) <= 2000)
SELECT p.l_partkey, p.l_suppkey, a.l_orderkey AS order_a, a.l_linenumber AS line_a, b.l_orderkey AS order_b, b.l_linenumber AS line_b FROM p JOIN l a ON a.ord = x JOIN l b ON b.ord = y""")
def band_twins(spark, sf_dir):
    """Lines of one part and supplier that are close in quantity and in price."""
    mark = F.struct("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    lines = t(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", mark.alias("ord")).distinct()
    pairs = M.band(lines, ["l_partkey", "l_suppkey"], [("l_quantity", 1.0), ("l_extendedprice", 2000.0)], "ord")
    return pairs.select("l_partkey", "l_suppkey", F.col("a.l_orderkey").alias("order_a"), F.col("a.l_linenumber").alias("line_a"), F.col("b.l_orderkey").alias("order_b"), F.col("b.l_linenumber").alias("line_b"))


@query()
def twin_leaders(spark, sf_dir):
    """Events of one user and kind that are close in value, each by its leader."""
    found = M.band(t(spark, sf_dir, "events").select("user_id", "event_type", "value", "event_id"), ["user_id", "event_type"], [("value", 0.5)], "event_id")
    return M.leaders(found, ["user_id", "event_type"])


@query("""
WITH s AS (SELECT DISTINCT o_custkey, o_orderkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
n AS (SELECT o_custkey, o_orderkey, count(*) AS size, list_sort(list(l_suppkey)) AS e FROM s GROUP BY ALL)
SELECT o_custkey, o_orderkey, size FROM n a WHERE NOT EXISTS (SELECT 1 FROM n b WHERE a.o_custkey = b.o_custkey AND a.size < b.size AND list_has_all(b.e, a.e))""")
def subset_elimination(spark, sf_dir):
    """SET1: a customer's orders whose suppliers are no true part of another order's."""
    orders = t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    lines = t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    n = max(lines.count(), orders.count())
    sets = M.dealt(lines, n, ["o_orderkey"]).join(M.dealt(orders, n, ["o_orderkey"]), "o_orderkey").distinct()
    return M.without_subsets(sets, ["o_custkey"], "o_orderkey", "l_suppkey")


@query("""
WITH a AS (SELECT s_suppkey * 2 + 1 AS alias, min(s_suppkey) AS s FROM supplier GROUP BY 1)
SELECT s_suppkey, s_name, false AS is_alias FROM supplier
UNION ALL SELECT alias, s_name, true FROM a JOIN supplier ON s_suppkey = s WHERE alias NOT IN (SELECT s_suppkey FROM supplier)""")
def alias_rows(spark, sf_dir):
    """SET3, J19: rows under generated ids that no original has."""
    return M.aliases(t(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), "s_suppkey", F.col("s_suppkey") * 2 + 1)


@query("""SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_discount < 0.05 EXCEPT ALL SELECT l_returnflag, l_linenumber FROM lineitem WHERE l_discount >= 0.05""")
def multiset_diff(spark, sf_dir):
    """SET5: what is left of one multiset after another, with repeats."""
    lines = t(spark, sf_dir, "lineitem")
    pick = lambda c: lines.where(c).select("l_returnflag", "l_linenumber")
    return pick("l_discount < 0.05").exceptAll(pick("l_discount >= 0.05"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'measure' WHEN o_orderpriority LIKE '1%' THEN 'boot' ELSE 'differs' END AS plan FROM orders""")
def plan_partition(spark, sf_dir):
    """SET9: what has to be measured, only booted, or compared."""
    orders = t(spark, sf_dir, "orders")
    return orders.select("o_orderkey", G.reasons(orders, [("measure", F.col("o_orderstatus") == "O"), ("boot", F.col("o_orderpriority").startswith("1"))], "differs").alias("plan"))


@query("""
WITH o AS (SELECT event_id * 7 % (SELECT count(*) FROM documents) AS doc_id, arg_max(event_type, event_id) AS source, max(event_id) AS line FROM events GROUP BY 1)
SELECT d.doc_id, coalesce(o.source, d.source) AS source, o.doc_id IS NOT NULL AND coalesce(o.source <> d.source, true) AS changed FROM documents d LEFT JOIN o USING (doc_id)""")
def override_merge(spark, sf_dir):
    """UPS1, UPS3, SRC13: the last override of an id replaces the row's value."""
    n = t(spark, sf_dir, "documents").count()
    over = t(spark, sf_dir, "events").select((F.col("event_id") * 7 % max(1, n)).alias("doc_id"), F.col("event_id").alias("line"), F.col("event_type").alias("new"))
    last = M.last_rows(over, ["doc_id"], "line")
    docs = t(spark, sf_dir, "documents").select("doc_id", "source").join(last, "doc_id", "left")
    return docs.select("doc_id", F.coalesce("new", "source").alias("source"), (F.col("line").isNotNull() & ~F.col("new").eqNullSafe(F.col("source"))).alias("changed"))


@query("""
SELECT doc_id, coalesce(CASE toxic WHEN 1 THEN 'toxic' END, CASE quality WHEN 1 THEN 'good' END, lang, 'sound ' || doc_id) AS name,
  CASE WHEN toxic = 1 THEN 'dat' WHEN quality = 1 THEN 'names' WHEN lang IS NOT NULL THEN 'manifest' ELSE 'fallback' END AS by_source FROM documents LEFT JOIN labels USING (doc_id)""")
def priority_names(spark, sf_dir):
    """UPS6, UPS5: a name by the priority of its sources."""
    docs = t(spark, sf_dir, "documents").select("doc_id", "lang").join(t(spark, sf_dir, "labels"), "doc_id", "left")
    tiers = [("dat", F.when(F.col("toxic") == 1, "toxic")), ("names", F.when(F.col("quality") == 1, "good")), ("manifest", F.col("lang"))]
    name = F.coalesce(*[v for _, v in tiers], F.concat_ws(" ", F.lit("sound"), F.col("doc_id").cast("string")))
    return docs.select("doc_id", name.alias("name"), F.coalesce(*[F.when(v.isNotNull(), n) for n, v in tiers], F.lit("fallback")).alias("by_source"))


@query("""
WITH a AS (SELECT event_id, value, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT event_id - 1 AS event_id, value, event_type FROM events WHERE event_id % 2 = 1 AND event_type <> 'error')
SELECT a.event_id, CASE WHEN b.value > 20 THEN b.value ELSE a.value END AS value, CASE WHEN b.value > 20 THEN b.event_type ELSE a.event_type END AS event_type, b.event_id IS NOT NULL AS retried FROM a LEFT JOIN b USING (event_id)""")
def retry_merge(spark, sf_dir):
    """SEL1, SEL2: a second attempt that gave sound replaces the first."""
    events = t(spark, sf_dir, "events").select("event_id", "value", "event_type")
    again = events.where("event_id % 2 = 1 and event_type != 'error'").withColumn("event_id", F.col("event_id") - 1)
    return M.second_attempt(events.where("event_id % 2 = 0"), again, "event_id", F.col("value") > 20)


@query("""
WITH m AS (SELECT l_suppkey, count(*) AS n, median(l_extendedprice) AS m FROM lineitem GROUP BY 1)
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, sign(m) * floor(abs(m) * 1000 + 0.5) / 1000 AS median FROM lineitem JOIN m USING (l_suppkey)
WHERE n >= 3 AND l_extendedprice > sign(m) * floor(abs(m) * 1000 + 0.5) / 1000 + 50000""")
def above_median_suspects(spark, sf_dir):
    """SEL3: lines far above the median of their supplier."""
    lines = t(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return M.above_median(lines, G.median(lines, ["l_suppkey"], "l_extendedprice"), ["l_suppkey"], "l_extendedprice", 50000, 3)


@query("""
WITH m AS (SELECT event_type, median(value) AS m0 FROM events GROUP BY 1), r AS (SELECT event_type, sign(m0) * floor(abs(m0) * 1000 + 0.5) / 1000 AS m FROM m)
SELECT event_type, arg_min(event_id, (abs(value - m), event_id)) AS reference FROM events JOIN r USING (event_type) GROUP BY 1""")
def median_reference(spark, sf_dir):
    """TOP6: the row that is closest to the median."""
    events = t(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return M.reference_of(events, G.median(events, ["event_type"], "value"), ["event_type"], "value", "event_id")


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size < 5 THEN p_size END, r, n, 255) AS level, CASE WHEN p_size < 5 THEN 'ours' WHEN r IS NOT NULL THEN 'reference' WHEN n IS NOT NULL THEN 'report' ELSE 'default' END AS origin
FROM part LEFT JOIN (SELECT l_partkey, nullif(count(*) FILTER (l_returnflag = 'R' AND l_discount = 0.1), 0) AS r, count(*) AS n FROM lineitem GROUP BY 1) ON l_partkey = p_partkey""")
def effective_value(spark, sf_dir):
    """VOL1, VOL2: the value that holds, and where it comes from: ours, the reference's, a report's, else the default."""
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("level"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") == 0.1)).alias("used"))
    used = lines.where("used > 0").select("p_partkey", F.col("used").alias("level"))
    ours = t(spark, sf_dir, "part").where("p_size < 5").select("p_partkey", F.col("p_size").cast("long").alias("level"))
    tiers = [("ours", ours, ["p_partkey"]), ("reference", used, ["p_partkey"]), ("report", lines.select("p_partkey", "level"), ["p_partkey"])]
    found = M.first_tier(t(spark, sf_dir, "part").select("p_partkey"), tiers, "level")
    return found.select("p_partkey", F.coalesce("level", F.lit(255)).alias("level"), F.coalesce("tier", F.lit("default")).alias("origin"))


@query("""
SELECT doc_id, source, n_chars FROM documents WHERE contains(lower(coalesce(text, '')), 'the') AND contains(lower(coalesce(text, '')), 'reth')
ORDER BY n_chars IS NULL, n_chars DESC, source, doc_id LIMIT 200""")
def search_page(spark, sf_dir):
    """FN16, TOP8: the first page of the documents that hold all words, nulls last."""
    hay = F.lower(F.coalesce("text", F.lit("")))
    found = t(spark, sf_dir, "documents").where(hay.contains("the") & hay.contains("reth"))
    return found.select("doc_id", "source", "n_chars").orderBy(F.col("n_chars").isNull(), F.desc("n_chars"), "source", "doc_id").limit(200)


@query("""SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing.path') AS missing FROM events""")
def json_paths(spark, sf_dir):
    """SRC11, PRJ17: paths of a report; a missing path is null."""
    return t(spark, sf_dir, "events").select("event_id", F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"), F.get_json_object("props", "$.missing.path").alias("missing"))


@query("""SELECT event_id, '[' || array_to_string([170, event_id % 256, 255 - event_id % 256, 85], ',') || ']' AS frame, '[' || array_to_string([(event_id % 256) // 16, event_id % 16], ',') || ']' AS nibbles FROM events""")
def framing(spark, sf_dir):
    """FN7, FN8: a byte as checked frame and as nibbles."""
    byte = (F.col("event_id") % 256).cast("int")
    text = lambda a: F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ","), F.lit("]"))
    return t(spark, sf_dir, "events").select("event_id", text(X.framed(byte, 170, 85)).alias("frame"), text(X.split_nibbles(byte)).alias("nibbles"))
