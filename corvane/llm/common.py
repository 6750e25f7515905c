"""What the operators of this subpackage share: stored intermediate tables and connected components."""

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import discard, stored

#: A side of at most so many small rows may be broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Texts of an Arrow batch that are Python objects at once.
TEXTS = 256


def slices(texts: pa.Array) -> Iterator[list]:
    """The values of an Arrow array as Python lists of few, so a batch of long texts is in memory once."""
    for at in range(0, len(texts), TEXTS):
        yield texts.slice(at, TEXTS).to_pylist()


def text_udf(of: Callable[[list], list | pa.Array], ddl: str, kind: pa.DataType) -> Callable[[Column], Column]:
    """A function of a text column, `of` a list of texts, as an Arrow UDF of type `ddl`, which is `kind` in Arrow. Said to
    be nondeterministic, it judges a text once, also where several fields or a filter follow."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [found if isinstance(found := of(x), pa.Array) else pa.array(found, kind) for x in slices(texts)]
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    return F.arrow_udf(run, ddl).asNondeterministic()


@contextmanager
def small_batches(spark: SparkSession, rows: int = TEXTS) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is stored inside, so that whole texts take little memory beside the
    executor's heap. The session's own setting is put back at the end; no result depends on it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def few(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast where a count says that it is small."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the links (a, b), two long columns.

    Returns (node, component), a row for each node of a link between two different nodes; component is the smallest
    node that links reach. Alternates the large-star and small-star steps (Kiveris et al., Connected Components in
    MapReduce and Beyond), all joins and partial aggregates; each round is a table in the shared folder that replaces
    the one before, and only a count and a checksum come to the driver. Null ends are ignored; repeated links, loops
    and no links are allowed.
    """
    links = (
        edges.where("a is not null and b is not null and a != b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    links = stored(links, "links")

    def state(df: DataFrame):
        return df.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()

    before = state(links)
    while before[0]:
        # Large star: every larger neighbour of a node moves to the smallest node around it.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        # Small star: every smaller neighbour of a node, and the node itself, moves to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = stored(small, "small")
        discard(links, large)
        links, after = small, state(small)
        if after == before:
            break
        before = after
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
