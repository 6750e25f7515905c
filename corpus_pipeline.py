"""A training corpus from documents: language ID, line dedup, near-dedup, mixing to target weights, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import langid, line_dedup, mixing, near_dedup, packing
from corvane.llm.common import small_batches
from corvane.session import stored
from corvane.sources.tables import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that their text shows. Where the score is sure, the text overrules the tag, and it fills a
    null one; documents without a letter or with too low a score for any learned language go. The rows are stored here,
    where texts go to Python in small Arrow batches.

    Null and empty texts have no letter and go. Repeated rows and ids are judged one by one, alike if their texts are. An
    empty table, and one that teaches no language, give an empty table. Very long texts count whole.
    """
    # Names of its own keep a table's columns apart from the judgement's; each text is in a row once.
    own = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    judged = langid.predict(docs.withColumnsRenamed(own), langid.train(docs), own["text"])
    judged = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= langid.LEAST))
    lang = F.when(F.col("score") >= langid.SURE, F.col("lang_pred")).otherwise(F.coalesce(own["lang"], "lang_pred"))
    with small_batches(spark):
        return stored(judged.select(*[(lang if c == "lang" else F.col(of)).alias(c) for c, of in own.items()]), "language_id")


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the boilerplate lines of their source, and their sizes.

    Copies of a text count as one page, as they go only in the next stage. Every row stays: null texts stay null, with a
    null size; a text of boilerplate alone stays as an empty one, and the next stage keeps one of those. A null source is
    a source of its own. An empty table gives an empty table.
    """
    cut = line_dedup.drop_lines(docs, min_pages=line_dedup.MIN_PAGES, distinct_pages=True)
    return cut.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, 0.8 or more alike on five words: the one of the smallest id.

    SimHash links are verified on whole shingle sets, and pairs that it cannot reach are proposed by MinHash bands. Texts
    without words, null ones included, are one group. Rows that repeat an id are one document: the first that is found
    stays. A group whose ids are all null keeps one row. An empty table gives an empty table.
    """
    return near_dedup.one_of_each(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weight of their source asks, within as many tokens as there are.

    Null sources are one source. Texts without words have no tokens: they come with their source's whole epochs, and a
    source of no tokens goes. Rows that repeat an id and source go together. An empty table gives an empty table.
    """
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequence, slot and tokens of each piece of each document; equal texts never share a sequence.

    Null texts are of no tokens and conflict with nothing but their source; null sources conflict with nothing. Repeated
    rows are copies of their own. Documents longer than a sequence are cut. An empty table gives an empty table.
    """
    # Near copies went before: what is left of a cluster is a document's repeats by the mixing.
    cluster = F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster")
    sized = docs.select("doc_id", "source", mixing.tokens(F.col("text")).alias("n_tokens"), cluster)
    return packing.pack(sized)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_boilerplate),
    ("simhash_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: SQL has neither the shingle hashes nor the classifier: each stage is tested against a plain version of its rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on the stored rows of the one before."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
