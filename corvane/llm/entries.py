"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontaminate, embedding_dedup, hard_negatives, langid, license_texts, licenses, line_dedup, mixing, near_dedup, packing, quality, simhash, spelling, url_filter, vptree
from corvane.sources.tables import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boilerplate lines cut from all documents, a source being a host: lines of over a tenth of its pages, four at least."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return line_dedup.drop_lines(docs, min_pages=line_dedup.MIN_PAGES).select("doc_id", "n_lines", "n_dropped", "text")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate vectors of equal labels at a cosine of 0.98 or more."""
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The license that each document is, by its digest."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan_licenses(docs).select("doc_id", "license_digest", "license_id", "is_license")


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate documents by fingerprints of 3-word shingles that differ in two bits or fewer."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_vptree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to every fiftieth one."""
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 50 = 0"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict on each page's url."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict", "pattern")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for each document, its source being the host and its language the path."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    return quality.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of a corpus of as many tokens in which sources have tempered weights."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "source", "n_tokens", "epoch", "block", "at")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document, learned from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training sequence of each piece of each document; texts that are 0.8 or more alike on five words are one cluster."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.tokens(F.col("text")).alias("n_tokens"), F.col("text").isNotNull().alias("has"), "text")
    sized = near_dedup.grouped(docs).withColumn("cluster", F.when(F.col("has"), F.col("root")))
    return packing.pack(sized)


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each document that stand in a passage of ten words that a benchmark item has too, and those items."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs, items)
    digest = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest, "contaminated")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of all documents with the near and much more frequent word that each is a variant of."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh row has the label after its own."""
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", noisy.alias("label"))
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_line_dedup, op2_embedding_dedup, op3_license_scan, op4_simhash_dedup, op5_vptree_search, op6_url_filter, op7_quality, op8_mixing, op9_language_id, op10_best_fit_packing, op11_decontaminate, op12_spelling_variants, op13_hard_negatives, pipeline)
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BARE = "trim({}, ' ' || chr(9) || chr(13))"

LINE_DEDUP_SQL = f"""
WITH pages AS (SELECT source, text FROM documents WHERE text IS NOT NULL),
total AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
shown AS (
  SELECT source, line, count(*) AS shown
  FROM (SELECT source, unnest(list_distinct(list_transform(string_split(text, chr(10)), lambda x: {_BARE.format("x")}))) AS line FROM pages)
  WHERE line <> '' GROUP BY source, line HAVING count(*) >= {line_dedup.MIN_PAGES}),
boiler AS (
  SELECT shown.source, list(line) AS lines FROM shown JOIN total ON shown.source IS NOT DISTINCT FROM total.source
  WHERE CAST(shown AS DOUBLE) / pages > {line_dedup.MAX_RATIO} GROUP BY shown.source),
cut AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS all_lines,
    list_filter(string_split(text, chr(10)), lambda x: lines IS NULL OR NOT list_contains(lines, {_BARE.format("x")})) AS kept
  FROM documents LEFT JOIN boiler ON documents.source IS NOT DISTINCT FROM boiler.source)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE CAST(len(all_lines) AS INTEGER) END AS n_lines,
  CASE WHEN text IS NULL THEN 0 ELSE CAST(len(all_lines) - len(kept) AS INTEGER) END AS n_dropped,
  CASE WHEN text IS NOT NULL THEN array_to_string(kept, chr(10)) END AS text
FROM cut"""


def _canonical_sql(column: str) -> str:
    out = f"translate({column}, '{licenses.UPPER}', '{licenses.LOWER}')"
    out = f"regexp_replace({out}, {_quoted(licenses.NOTICE)}, '', 'g')"
    out = f"replace(' ' || regexp_replace({out}, {_quoted(licenses.OTHER)}, ' ', 'g') || ' ', ' ', '  ')"
    for one, other in licenses.SPELLINGS:
        out = f"replace({out}, {_quoted(' ' + one.replace(' ', '  ') + ' ')}, {_quoted(f' {other} ')})"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


LICENSE_SCAN_SQL = f"""
WITH known AS (
  SELECT license_digest, min(license_id) AS license_id FROM (
    SELECT sha256({_canonical_sql("body")}) AS license_digest, license_id
    FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(t)})" for i, t in license_texts.LICENSES)}) AS v(license_id, body)
    UNION ALL SELECT license_digest, license_id FROM (VALUES {", ".join(f"({_quoted(i)}, {_quoted(d)})" for i, d in license_texts.DIGESTS)}) AS d(license_id, license_digest)) GROUP BY 1),
scanned AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS license_digest FROM documents)
SELECT doc_id, license_digest, license_id, license_id IS NOT NULL AS is_license FROM scanned LEFT JOIN known USING (license_digest)"""

_RULES_SQL = "\n".join(
    f"    WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
    for h, p in (("www.example.com", "/en/"), ("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/"), ("com", "/"))
)
URL_FILTER_SQL = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), '{licenses.UPPER}', '{licenses.LOWER}') AS host,
    coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '://[^/?#]*([\\s\\S]*)', 1), '') AS rest
  FROM pages),
ruled AS (
  SELECT page_id, host, path, host || rest AS subject, CASE
{_RULES_SQL}
  END AS rule FROM parts),
fitted AS (
  SELECT *, CASE WHEN rule IS NULL THEN (
    SELECT max(struct_pack(n := length(name), name := name)).name FROM (VALUES {", ".join(f"({_quoted(r.name)}, {_quoted(r.regex)})" for r in url_filter.PATTERN_RULES)}) AS p(name, regex)
    WHERE regexp_matches(subject, regex)) END AS pattern FROM ruled)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern
FROM fitted"""

_ABLE_SQL = """
able AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0)"""

EMBEDDING_DEDUP_SQL = f"""
WITH RECURSIVE {_ABLE_SQL},
linked AS (
  SELECT DISTINCT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {embedding_dedup.THRESHOLD}),
reach AS (SELECT a AS vec_id, b AS other FROM linked UNION SELECT r.vec_id, l.b FROM reach r JOIN linked l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(other, vec_id)) AS component_id,
  coalesce(vec_id = least(vec_id, coalesce(other, vec_id)), false) AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) LEFT JOIN least USING (vec_id) LEFT JOIN counts USING (vec_id)"""

NEAREST_SQL = f"""
WITH {_ABLE_SQL},
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, max(list_cosine_similarity(q.e, c.e)) AS score
  FROM able q JOIN able c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0 GROUP BY ALL)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5"""


def _hash_sql(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


def _bisect_sql(name: str, keep: str) -> str:
    """Bisection of the exponent: `keep` says of the middle `m` whether the lower end moves up."""
    return f"""
{name}(i, lo, hi) AS (
  SELECT 0, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE)
  UNION ALL
  SELECT i + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END
  FROM (SELECT i, lo, hi, m, {keep} AS up
    FROM (SELECT i, lo, hi, (lo + hi) / 2 AS m FROM {name}) b, total,
      LATERAL (SELECT sum(pow(p, b.m)) AS z, sum(pow(p, b.m) * ln(p)) AS zl FROM shares) s)
  WHERE i < {mixing.STEPS})"""


_Z1 = "(SELECT sum(pow(p, {a}) * {x}) FROM shares)"
MIXING_SQL = f"""
WITH RECURSIVE light AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS k, 's' || source AS src,
    CAST(coalesce(len(regexp_extract_all(text, {_quoted(mixing.WORD)})), 0) AS BIGINT) AS n_tokens FROM documents),
sources AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM light GROUP BY src HAVING sum(n_tokens) > 0),
total AS (SELECT CAST(sum(tokens) AS DOUBLE) AS total, min(tokens) AS least, count(*) AS n FROM sources),
shares AS (SELECT src, tokens / total AS p FROM sources, total),
{_bisect_sql("even", f"ln(z) - m * zl / z >= {mixing.ENTROPY} * ln(n)")},
{_bisect_sql("spare", f"pow(least / total, m - 1) / z > {mixing.REPEATS}")},
ends AS (SELECT
  CASE WHEN {_Z1.format(a="1", x="ln(p)")} * -1 >= {mixing.ENTROPY} * (SELECT ln(n) FROM total) THEN 1.0
    ELSE (SELECT max_by(lo, i) FROM even) END AS a,
  CASE WHEN (SELECT pow(least / total, -1) / n FROM total) <= {mixing.REPEATS} THEN 0.0 ELSE (SELECT max_by(hi, i) FROM spare) END AS b),
chosen AS (SELECT CAST(greatest(a, b) AS DOUBLE) AS a FROM ends),
plan AS (
  SELECT src, tokens, CAST(floor(pow(p, a) / z * total + 0.5) AS BIGINT) AS quota, least({mixing.MOST_BLOCKS}, CAST(ceil(tokens / {mixing.BLOCK_TOKENS}.0) AS BIGINT)) AS blocks
  FROM sources JOIN shares USING (src), total, chosen, (SELECT sum(pow(p, (SELECT a FROM chosen))) AS z FROM shares)),
parts AS (SELECT *, quota // tokens AS whole, quota % tokens AS rest FROM plan WHERE quota > 0),
dealt AS (SELECT *, {_hash_sql(str(mixing.SEED), "'block'", "k")} % blocks AS block FROM light JOIN parts USING (src)),
shown AS (
  SELECT *, {_hash_sql(str(mixing.SEED), "'turn'", "src", "epoch", "block")} AS turn, {_hash_sql(str(mixing.SEED), "'place'", "epoch", "k")} AS place
  FROM (SELECT *, unnest(range(whole + 1)) AS epoch FROM dealt)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY src, epoch ORDER BY turn, block, place, k) AS upto FROM shown),
stop AS (SELECT src, epoch, min((turn, block, place, k)) AS at FROM summed WHERE upto > rest AND epoch = whole GROUP BY ALL)
SELECT doc_id, source, n_tokens, epoch, block, (epoch + turn / {mixing.SPAN}) * tokens / quota AS at
FROM summed LEFT JOIN stop USING (src, epoch)
WHERE epoch < whole OR rest > 0 AND (turn, block, place, k) < stop.at"""

_WORDS_SQL = f"regexp_extract_all(translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
item_windows AS (
  SELECT item_id, n, array_to_string(w[a:a + n - 1], ' ') AS words
  FROM (SELECT item_id, w, least(len(w), {decontaminate.SPAN}) AS n, unnest(range(1, len(w) - least(len(w), {decontaminate.SPAN}) + 2)) AS a FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_words AS (SELECT row_number() OVER () AS k, doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS w FROM documents),
doc_windows AS (
  SELECT k, n, a, array_to_string(w[a:a + n - 1], ' ') AS words
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM doc_words, sizes WHERE len(w) >= n)),
hits AS (SELECT DISTINCT k, n, a, words FROM doc_windows SEMI JOIN item_windows USING (n, words)),
places AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(a, a + n)) AS p FROM hits) GROUP BY k),
items AS (
  SELECT k, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items
  FROM (SELECT DISTINCT k, n, words FROM hits) JOIN item_windows USING (n, words) WHERE item_id IS NOT NULL GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
  sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (k) LEFT JOIN items USING (k)"""

_CRC_TABLE_SQL = "list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))"
SPELLING_SQL = f"""
WITH RECURSIVE found AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.LOWER}'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents)
  WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY doc_id, run),
byted AS (
  SELECT run, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS hexed FROM found),
crc AS (
  SELECT run, k, xor(4294967295, list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(hexed), 2), lambda i: CAST('0x' || substr(hexed, CAST(i AS INT) + 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h
  FROM byted, (SELECT {_CRC_TABLE_SQL} AS t)),
words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT k, CASE WHEN h % {spelling.NOISE} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM crc)
  WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(k) >= {spelling.LEAST_COUNT}),
cut AS (SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word AS word, b.word AS near FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT cut.word, words.word FROM cut JOIN words ON words.word = cut.rest
  UNION SELECT words.word, cut.word FROM cut JOIN words ON words.word = cut.rest),
best AS (
  SELECT near.word, count(*) AS n_near, max(n) AS m, min_by(near, (-n, near)) AS near
  FROM near JOIN words ON words.word = near.near GROUP BY near.word),
formed AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * n THEN near END AS form, CASE WHEN m >= {spelling.RATIO} * n THEN m END AS form_n
  FROM words LEFT JOIN best USING (word)),
led AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT led.word, formed.form, steps + 1 FROM led JOIN formed ON formed.word = led.root WHERE formed.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT word, max_by(root, steps) AS root FROM led GROUP BY word) USING (word)"""

HARD_NEGATIVES_SQL = f"""
WITH able AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({hard_negatives.SCALE} * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_inner_product(a.e, b.e) AS BIGINT) AS score
  FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {hard_negatives.POSITIVES})
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND {hard_negatives.LEAST} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.MOST} * positive_score
QUALIFY rank <= {hard_negatives.NEGATIVES}"""

ORACLES = {
    "op1_line_dedup": LINE_DEDUP_SQL,
    "op2_embedding_dedup": EMBEDDING_DEDUP_SQL,
    "op3_license_scan": LICENSE_SCAN_SQL,
    "op5_vptree_search": NEAREST_SQL,
    "op6_url_filter": URL_FILTER_SQL,
    "op8_mixing": MIXING_SQL,
    "op11_decontaminate": DECONTAMINATE_SQL,
    "op12_spelling_variants": SPELLING_SQL,
    "op13_hard_negatives": HARD_NEGATIVES_SQL,
}
