"""License scan by canonical digests: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import BROADCAST_ROWS
from corvane.llm.license_texts import DIGESTS, LICENSES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Words that the public license matching guidelines treat as equal, in the order in which they are replaced.
# Words stand without punctuation, as they do once it is gone.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("artefacts", "artifacts"),
    ("authorisation", "authorization"),
    ("authorise", "authorize"),
    ("authorised", "authorized"),
    ("authorises", "authorizes"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("catalogues", "catalogs"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("centres", "centers"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("programmes", "programs"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("recognised", "recognized"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sub licensed", "sublicensed"),
    ("sub licenses", "sublicenses"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
    ("https", "http"),
    ("all rights reserved", ""),
]
#: A line that is a copyright notice: after comment marks the word with a sign, a year or its blank, or "by"; or a sign
#: with one of those. A wrapped line that happens to begin with the word is none.
NOTICE = r"(?m)^[^\p{L}\p{N}\n(©&]*(?:portions )?(?:copyright[ \t:,-]*(?:\(c\)|©|&copy;|[0-9<\[{]|by\b)|\(c\)[ \t]*(?:copyright\b|by\b|[0-9<\[{])|©|&copy;)[^\n]*"
OTHER = r"[^\p{L}\p{N}]+"
_VARIANT = " (?:" + "|".join(one for one, _ in SPELLINGS) + ") "


def canonical(text: Column) -> Column:
    """`text` without what does not tell licenses apart: case of A-Z, lines that are copyright notices, punctuation,
    blanks, line breaks, and equivalent spellings of whole words. Null stays null.

    Where a text breaks its lines makes no difference, unless a notice takes more than one line.
    """
    words = F.translate(text, UPPER, LOWER)
    words = F.regexp_replace(words, NOTICE, "")
    words = F.concat(F.lit(" "), F.regexp_replace(words, OTHER, " "), F.lit(" "))
    # Each word has blanks of its own while spellings are replaced, so neighbours don't share one. Few texts have any.
    spelled = F.replace(words, F.lit(" "), F.lit("  "))
    for one, other in SPELLINGS:
        spelled = F.replace(spelled, F.lit(f" {one.replace(' ', '  ')} "), F.lit(f" {other} "))
    spelled = F.regexp_replace(spelled, " +", " ")
    return F.trim(F.when(F.regexp_like(words, F.lit(_VARIANT)), spelled).otherwise(words))


def known_digests(spark: SparkSession, licenses: DataFrame | None = None) -> DataFrame:
    """(license_digest, license_id): of `licenses` (license_id, text), by default the texts and digests that come with the
    library. Of licenses with equal digests the first id stands; null and empty texts are left out."""
    texts = spark.createDataFrame(LICENSES, "license_id string, text string") if licenses is None else licenses
    digests = texts.select("license_id", canonical(F.col("text")).alias("c")).where("c is not null and c != ''").select(F.sha2("c", 256).alias("license_digest"), "license_id")
    if licenses is None:
        digests = digests.unionByName(spark.createDataFrame(DIGESTS, "license_id string, license_digest string"))
    return digests.groupBy("license_digest").agg(F.min("license_id").alias("license_id"))


def scan_licenses(docs: DataFrame, licenses: DataFrame | None = None, text: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`docs` with license_digest, license_id and is_license: the license whose whole text the whole `text` is.

    Every row stays. A null text has a null digest and no license; a text that is empty after canonicalisation has a
    digest that no license has. Repeated rows are treated alike; an empty table gives an empty table. Columns of
    `docs` under the three names are replaced. A map-only pass while the digests are few enough to be broadcast: the
    built-in ones are counted when the library is written, others before the join; beyond that a shuffle by digest.
    """
    few = len(LICENSES) <= broadcast_rows if licenses is None else licenses.count() <= broadcast_rows
    known = known_digests(docs.sparkSession, licenses)
    names = [c for c in docs.columns if c not in ("license_digest", "license_id", "is_license")]
    out = docs.select(*names, F.sha2(canonical(F.col(text)), 256).alias("license_digest"))
    out = out.join(F.broadcast(known) if few else known, "license_digest", "left")
    return out.select(*names, "license_digest", "license_id", F.col("license_id").isNotNull().alias("is_license"))
